"""Near-duplicate passages by compact windows.

A passage is PASSAGE words; two are near duplicates if the sets of their 5-word shingles (A-Z lower-cased) have a
Jaccard similarity of at least SIMILAR.

1. Windows. For each of HASHES hash functions, the Cartesian tree over a text's shingle hashes has the least hash as
   its root and the parts to its left and right as subtrees; the passages whose least hash is one node's are that
   node's compact window (first start, last start, place of the least hash). Only nodes whose subtree is as long as a
   passage have any, about two in PASSAGE words; they are the places that are least of some passage, which sliding
   minima give without building the rest of the tree. A window is kept if another text has the same least hash.
2. Interval join within a text: a window stays if some passage in it has AGREE kept windows of different hashes. The
   words around such passages (*regions*) are all that is needed of the texts from here on.
3. Interval join across texts: windows with one hash are joined as a star with the first of their texts; where the
   windows of a pair of texts overlap AGREE times along about one diagonal, the passages there are a candidate. Of
   the centres of a text in one task only as many are tried as its shared stretches need. The best place of each pair
   of texts is verified: both passages, and those up to half a window before and after, are
   taken from the regions and compared exactly. Verified pairs are connected.
4. What the star leaves: passages with AGREE windows whose hash still has two classes. If two of them are near
   duplicates and of different classes, 4 in 5 of their shingles occur in another class; most passages fail that
   count, as they only share a line or a short quotation. For those that pass, order the shingles by the number of
   classes that have them: near duplicates share one of the first few (6 of 46). The windows of these rare shingles,
   narrow and short, are joined by shingle: as stars, which settle groups of like texts, again with other centres
   while very many pairs would be left, then all with all between classes that are still different, and every place of
   every pair is verified.

So every pair of texts with AGREE windows in common is either found alike or compared exactly wherever it can be alike:
nothing is cut off after some turns, at some size or at one place. The first star's work grows with the windows. The
last join is between classes that share a rare shingle; a shingle with many is split into pairs of blocks of BLOCK
windows, so that no task holds more than one of them.

With similarity s, the chance that AGREE of HASHES agree is 0.99 at s = 0.8 and 1 for equal passages; text by text the
many passages of a longer repeat raise it further. Texts that are equal as a whole are one class from the start, so
groups of copies are one text in all steps. A hash that a batch holds more than once is looked up once.

The result is the class alone, exact up to the candidates. Links within a class are not counted: texts that are in one
class already are not compared again.

Defined results: null and empty texts and texts under PASSAGE words have no passage and are a class of their own;
equal texts of PASSAGE words or more share their class; the class id is the least doc_id in it; null doc_ids
are a class id only if there is no other; repeated rows are kept; texts of any length are taken whole, a piece at a
time; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm._common import SPLIT, discard, slices, written
from premia.llm.components import connected
from premia.llm.suffix_dedup import _dealt, _doc_part, _hash_part, _in_batches, _two_docs, _with_texts, unpack, with_texts

PASSAGE, SHINGLE, SIMILAR = 50, 5, 0.8
HASHES, AGREE = 8, 4
TURNS = 3  # stars of rare windows before the last join, as long as that has more than MANY pairs a task
MANY = 1 << 14
AT_ONCE = 1 << 18  # links that one task connects; more are connected by rounds over the cluster
FEW, PACKED = 12, 2 << 20  # tasks for the rare windows: at least, and bytes of them, packed, for one
BLOCK = 512  # windows of one hash that are joined all with all at once
CHUNK = 1 << 19  # pairs of windows that are made, or grouped by pair of texts, at once
REPEATS, PLAIN = -2, -1  # marks in `row`: windows of passages that repeat themselves, and others that are to meet those
NEAR = 16  # words by which the diagonals of one candidate may differ
STARTS = PASSAGE - SHINGLE + 1
HALF = STARTS // 2
FULL = math.ceil(STARTS * 2 * SIMILAR / (1 + SIMILAR) - 1e-9)  # shingles that two passages without repeats must share
PIECE = 1 << 20  # bytes of text, or words of it, that are hashed at once
BLOB = "part long, kind int, blob binary"
NODE = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("span", "u1"), ("at", "u1"), ("known", "u1"), ("row", "i1")])
LABEL = np.dtype([("doc", "<i8"), ("label", "<i8")])
LABELLED = np.dtype([*((n, NODE[n]) for n in NODE.names), ("label", "<i8")])
CELL = np.dtype([*((n, LABELLED[n]) for n in LABELLED.names), ("cell", "<u8"), ("side", "u1")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("delta", "<i4"), ("j", "u1")])
ASK = np.dtype([("key", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("side", "u1")])
REGION = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("words", "<u4"), ("size", "<u4")])
ASKED = np.dtype([("hash", "<u8"), ("texts", "<u4"), ("least", "<i8"), ("most", "<i8"), ("part", "<u4")])
ANSWER = np.dtype([("hash", "<u8"), ("texts", "<u4")])
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BETWEEN = re.compile(rb"[\t\n\x0b\f\r ]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _M[1]
        h = (h ^ (h >> np.uint64(29))) * _M[2]
        return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(n, _M[3], np.uint64))


_PW = _powers(1 << 16)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each begins)."""
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    own = b[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(end - begin) - (end - begin)
    place = (np.arange(len(own)) - np.repeat(first, end - begin)) & 0xFFFF
    with np.errstate(over="ignore"):
        return _mix(np.add.reduceat(own * _PW[place], first) + (end - begin).astype(np.uint64)), begin


def hashes_of(text: bytes) -> np.ndarray:
    """The hash of each word of a text of any length, cut between words."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _BETWEEN.search(text, end)
            end = found.start() if found else len(text)
        out.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    n = len(w) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = w[:n].copy()
        for k in range(1, SHINGLE):
            h = h * _M[4] + w[k : n + k]
    return _mix(h)


def windows(s: np.ndarray, valid: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of hash j: (hash, first start, last start, place of the least hash) over valid starts."""
    with np.errstate(over="ignore"):
        h = _mix(s * _M[5] + _M[6] * np.uint64(2 * j + 1))
    low = np.uint64((1 << 24) - 1)
    m, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= STARTS:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    if size < STARTS:
        m = np.minimum(m[: len(m) - (STARTS - size)], m[STARTS - size :])
    c = (m[valid] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    return (h[c[cut]] & ~np.uint64(0xFFFF)) | np.uint64(j), valid[cut], valid[np.append(cut[1:], len(valid)) - 1], c[cut]


def find_windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: windows to look up, dealt by hash. Kind 1: windows known to be shared, dealt by text."""
    for docs, _, texts, _ in _in_batches(batches):
        found = []
        group, size, runs = [], 0, []
        for i, t in enumerate(texts):
            if len(t) >= PIECE:
                runs.append([i])
                continue
            group.append(i)
            size += len(t)
            if size >= PIECE:
                runs.append(group)
                group, size = [], 0
        for run in [*runs, group]:
            if len(run) == 1:
                w = hashes_of(texts[run[0]])
                first = np.array([0, len(w)])
            else:
                w, begin = word_hashes(b"\n".join(texts[i] for i in run))
                first = np.searchsorted(begin, np.cumsum([0, *(len(texts[i]) + 1 for i in run)]))  # of each text, its first word
            if len(w) < PASSAGE:
                continue
            own = np.searchsorted(first, np.arange(len(w)), side="right") - 1
            every = np.flatnonzero(np.arange(len(w)) + PASSAGE <= first[own + 1])
            s = shingle_hashes(w)
            for valid in np.split(every, range(PIECE, len(every), PIECE)):
                if not len(valid):
                    continue
                base = valid[0]
                for j in range(HASHES):
                    h, lo, hi, c = windows(s[base : valid[-1] + STARTS], valid - base, j)
                    out = np.zeros(len(h), NODE)
                    d = own[lo + base]
                    out["hash"], out["doc"], out["lo"], out["span"], out["at"] = h, np.array(docs, np.int64)[np.array(run)[d]], lo + base - first[d], hi - lo, c - lo
                    found.append(out)
        if not found:
            continue
        out = np.concatenate(found)
        twice = _two_docs(out["hash"], out["doc"])
        if twice.any():
            settled = out[twice]
            yield _dealt(_doc_part(settled["doc"], parts), settled, 1)
            one = settled[np.unique(settled["hash"], return_index=True)[1]]
            one["known"] = 1
            out = np.concatenate([out[~twice], one])
        yield _dealt(_hash_part(out["hash"], parts), out, 0)


def shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The windows whose hash another text has, dealt by text."""
    held = []
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                held.append(unpack(blob, NODE))
            else:
                yield _row(part, blob)
    if held:
        a = np.concatenate(held)
        a = a[_two_docs(a["hash"], a["doc"], a["known"]) & (a["known"] == 0)]
        if len(a):
            yield _dealt(_doc_part(a["doc"], parts), a, 0)


def _row(part: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])


def _read(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    held = [unpack(x, dtype) for batch in batches for x in batch.column(2).to_pylist()]
    return np.concatenate(held) if held else np.zeros(0, dtype)


def cover(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sweep over closed intervals: (where the count changes, the count from there on)."""
    at = np.concatenate([lo, hi + 1])
    step = np.concatenate([np.ones(len(lo), np.int64), -np.ones(len(hi), np.int64)])
    places, which = np.unique(at, return_inverse=True)
    return places, np.cumsum(np.bincount(which, step)).astype(np.int64)


def _agree(a: np.ndarray) -> np.ndarray:
    """The windows with a passage that AGREE of them, of different hashes, hold."""
    if not len(a):
        return a
    a = np.unique(a)  # copies of a text send its windows more than once
    _, text = np.unique(a["doc"], return_inverse=True)
    base = text.astype(np.int64) << 32
    lo, hi = base + a["lo"], base + a["lo"] + a["span"]
    places, count = cover(lo, hi)
    enough = np.concatenate([[0], np.cumsum(count >= AGREE)])
    first, last = np.searchsorted(places, lo), np.searchsorted(places, hi, side="right")
    return a[enough[last] > enough[first]]


def agreeing(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Windows with a passage that AGREE windows of different hashes hold, dealt by text."""
    a = _agree(_read(batches, NODE))
    if len(a):
        yield _dealt(_doc_part(a["doc"], parts), a, 0)


def _labelled(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Windows (kind 0) with the class of their text (kind 1), or the text itself as its class."""
    windows_, labels = [], []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (labels if kind else windows_).append(unpack(blob, LABEL if kind else NODE))
    a = np.concatenate(windows_) if windows_ else np.zeros(0, NODE)
    out = np.zeros(len(a), LABELLED)
    for n in NODE.names:
        out[n] = a[n]
    out["label"] = _labels_of(a["doc"], np.concatenate(labels) if labels else np.zeros(0, LABEL))
    return out


def _labels_of(doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    if not len(labels):
        return doc
    labels = labels[np.argsort(labels["doc"])]
    at = np.minimum(np.searchsorted(labels["doc"], doc), len(labels) - 1)
    return np.where(labels["doc"][at] == doc, labels["label"][at], doc)


def named(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Windows with their classes, dealt by hash."""
    out = _labelled(batches)
    if len(out):
        yield _dealt(_hash_part(out["hash"], parts), out, 0)


def pack_labels(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """node, label as packed rows of kind 1, dealt by text."""
    for batch in batches:
        if batch.num_rows:
            out = np.zeros(batch.num_rows, LABEL)
            out["doc"], out["label"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            yield _dealt(_doc_part(out["doc"], parts), out, 1)


def _pair_part(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _hash_part(_mix(np.ascontiguousarray(a).view(np.uint64) * _M[0] + np.ascontiguousarray(b).view(np.uint64)), parts)


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of windows with equal hashes, with the starts in x that are possible along their diagonal."""
    out = np.zeros(len(x), PAIR)
    cx, cy = x["lo"].astype(np.int64) + x["at"], y["lo"].astype(np.int64) + y["at"]
    delta = cy - cx
    out["a"], out["b"], out["delta"], out["j"] = x["doc"], y["doc"], delta, x["hash"] & np.uint64(0xFFFF)
    out["lo"] = np.maximum(x["lo"], y["lo"] - delta)
    out["hi"] = np.minimum(x["lo"].astype(np.int64) + x["span"], y["lo"].astype(np.int64) + y["span"] - delta)
    return out[out["lo"] <= out["hi"]]


def _ordered(p: np.ndarray) -> np.ndarray:
    """The pairs with the lesser text first."""
    swap = p["a"] > p["b"]
    turned = p[swap].copy()
    turned["a"], turned["b"], turned["delta"] = p["b"][swap], p["a"][swap], -p["delta"][swap]
    turned["lo"], turned["hi"] = p["lo"][swap] + p["delta"][swap], p["hi"][swap] + p["delta"][swap]
    p[swap] = turned
    return p


def _open(a: np.ndarray, key: str = "hash") -> np.ndarray:
    """Of windows sorted by hash (or cell): does it come with two classes?"""
    begin = np.flatnonzero(np.concatenate([[True], a[key][1:] != a[key][:-1]]))
    two = np.minimum.reduceat(a["label"], begin) != np.maximum.reduceat(a["label"], begin)
    return np.repeat(two, np.diff(np.append(begin, len(a))))


def _needed(centre: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the pairs (a centre's window, a text's own) to try: for each text the centre that most of its windows
    share, then others that have AGREE windows outside the stretches of those taken. What two centres would say of one
    stretch is the same link twice, or is left to the later joins."""
    order = np.lexsort((own["lo"], centre["doc"], own["doc"]))
    c, o = centre[order], own[order]
    begin = np.flatnonzero(np.concatenate([[True], (o["doc"][1:] != o["doc"][:-1]) | (c["doc"][1:] != c["doc"][:-1])]))
    end = np.append(begin[1:], len(o))
    lo, hi = o["lo"].astype(np.int64), o["lo"].astype(np.int64) + o["span"]
    keep = np.zeros(len(o), bool)
    by_text = np.lexsort((begin - end, o["doc"][begin]))
    text, taken = None, []
    for g in by_text.tolist():
        b, e = int(begin[g]), int(end[g])
        if o["doc"][b] != text:
            text, taken = o["doc"][b], []
        outside = np.ones(e - b, bool)
        for first, last in taken:
            outside &= (hi[b:e] < first) | (lo[b:e] > last)
        if np.count_nonzero(outside) >= AGREE:
            keep[b:e] = True
            taken.append((int(lo[b:e][outside].min()), int(hi[b:e][outside].max())))
    out = np.zeros(len(own), bool)
    out[order] = keep
    return out


def _star(a: np.ndarray, need: bool = False, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of each window with the first of its hash, if that is of another class; the first ones).

    need: a holds all windows of its texts, so that of each text's centres only the needed ones are paired.
    turn: 0 has one order of texts for all hashes, later turns one for each hash, so that a text meets many centres.
    """
    with np.errstate(over="ignore"):
        rank = _mix(np.ascontiguousarray(a["doc"]).view(np.uint64) + (a["hash"] * _M[7] + np.uint64(turn) if turn else np.uint64(0)))
    a = a[np.lexsort((a["lo"], a["doc"], rank, a["hash"]))]
    fresh = np.concatenate([[True], a["hash"][1:] != a["hash"][:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    other = (a["doc"] != a["doc"][first]) & (a["label"] != a["label"][first])
    x, y = a[first[other]], a[other]
    if need and len(x):
        keep = _needed(x, y)
        x, y = x[keep], y[keep]
    return _ordered(_joined(x, y)), a[fresh]


def local_stars(batches: Iterator[pa.RecordBatch], parts: int, need: bool, turn: int = 0) -> Iterator[pa.RecordBatch]:
    """Stars within a task, dealt by pair of texts (kind 0), and their centres, dealt by hash (kind 1).

    However many texts have a hash, a task sends one of them on.
    """
    a = _labelled(batches)
    a = a[a["row"] >= 0]
    if len(a):
        p, centres = _star(a, need, turn)
        if len(p):
            yield _dealt(_pair_part(p["a"], p["b"], parts), p, 0)
        yield _dealt(_hash_part(centres["hash"], parts), centres, 1)


def stars(batches: Iterator[pa.RecordBatch], parts: int, turn: int = 0) -> Iterator[pa.RecordBatch]:
    """The stars of the tasks' centres, dealt by pair of texts."""
    a = _read(batches, LABELLED)
    if len(a):
        p, _ = _star(a, turn=turn)
        if len(p):
            yield _dealt(_pair_part(p["a"], p["b"], parts), p, 0)


def _asked(hashes: np.ndarray, doc: np.ndarray, label: np.ndarray, part: int) -> np.ndarray:
    """One row for each hash of a part: how many of its texts have it, and the least and the greatest class."""
    order = np.lexsort((doc, hashes))
    hashes, doc, label = hashes[order], doc[order], label[order]
    fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    begin = np.flatnonzero(fresh)
    change = fresh | np.concatenate([[True], doc[1:] != doc[:-1]])
    out = np.zeros(len(begin), ASKED)
    out["hash"], out["texts"], out["least"], out["most"], out["part"] = hashes[begin], np.add.reduceat(change.astype(np.int64), begin), np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin), part
    return out


def ask_windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The hashes of the windows of each part with their classes, dealt by hash."""
    for part, (a, labels), _ in _by_part(batches, (NODE, LABEL)):
        if len(a):
            out = _asked(a["hash"], a["doc"], _labels_of(a["doc"], labels), part)
            yield _dealt(_hash_part(out["hash"], parts), out, 0)


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each part that asked, the hashes that come with two classes anywhere, and how many texts have them (kind 1)."""
    a = _read(batches, ASKED)
    if not len(a):
        return
    a = a[np.argsort(a["hash"], kind="stable")]
    begin = np.flatnonzero(np.concatenate([[True], a["hash"][1:] != a["hash"][:-1]]))
    size = np.diff(np.append(begin, len(a)))
    two = np.minimum.reduceat(a["least"], begin) != np.maximum.reduceat(a["most"], begin)
    some = np.repeat(two, size)
    if some.any():
        out = np.zeros(np.count_nonzero(some), ANSWER)
        out["hash"], out["texts"] = a["hash"][some], np.repeat(np.minimum(np.add.reduceat(a["texts"].astype(np.int64), begin), (1 << 32) - 1), size)[some]
        yield _dealt(a["part"][some].astype(np.int64), out, 1)


def open_windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The windows whose hash has two classes, at passages with AGREE of them; dealt by text."""
    for _, (a, two), _ in _by_part(batches, (NODE, ANSWER)):
        a = _agree(a[np.isin(a["hash"], two["hash"])])
        if len(a):
            yield _dealt(_doc_part(a["doc"], parts), a, 0)


def spread(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The windows of each hash with two classes, in cells: pairs of blocks of them. pairs: those of the cells."""
    a = _read(batches, LABELLED)
    if not len(a):
        return
    a = a[np.lexsort((a["lo"], a["doc"], a["label"], a["row"] == PLAIN, a["hash"]))]
    a = a[_open(a)]
    if not len(a):
        return
    begin = np.flatnonzero(np.concatenate([[True], a["hash"][1:] != a["hash"][:-1]]))
    size = np.diff(np.append(begin, len(a)))
    block = (np.arange(len(a)) - np.repeat(begin, size)) // BLOCK
    # windows marked PLAIN, the last of their hash, only meet others: blocks of them alone do not meet each other
    meets = np.add.reduceat((a["row"] != PLAIN).astype(np.int64), begin)
    a, block, blocks, lead = (x[np.repeat(meets > 0, size)] for x in (a, block, np.repeat(-(-size // BLOCK), size), np.repeat(-(-meets // BLOCK), size)))
    if not len(a):
        return
    for k in range(0, int(blocks.max())):  # each window meets block k of its hash
        here = (blocks > k) & (np.minimum(block, k) < lead)
        some = a[here]
        own, out = block[here], np.zeros(len(some), CELL)
        for n in LABELLED.names:
            out[n] = some[n]
        low, high = np.minimum(own, k).astype(np.uint64), np.maximum(own, k).astype(np.uint64)
        with np.errstate(over="ignore"):
            out["cell"] = _mix(some["hash"] * _M[0] + (low << np.uint64(32)) + high + np.uint64(1))
        out["side"] = np.where(own == k, 0, np.where(own > k, 2, 1))  # 1: the lesser block of two, 2: the greater
        whole = out[out["side"] == 0]
        if len(whole):
            yield _dealt(_hash_part(whole["cell"], parts), whole, 0)
        if k or int(blocks.max()) > 1:
            rest = out[out["side"] > 0]
            if len(rest):
                yield _dealt(_hash_part(rest["cell"], parts), rest, 0)


def all_pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All pairs of windows of a cell that are of different texts and classes, dealt by pair of texts."""
    a = _read(batches, CELL)
    if not len(a):
        return
    a = a[np.lexsort((a["doc"], a["label"], a["side"], a["cell"]))]
    a = a[_open(a, "cell")]
    n = len(a)
    if not n:
        return
    edge = np.concatenate([[True], (a["cell"][1:] != a["cell"][:-1])])
    stop = np.append(np.flatnonzero(edge)[1:], n)[np.cumsum(edge) - 1]
    # within a block: with the windows of later labels; across two: with all of the greater block
    run = np.concatenate([[True], edge[1:] | (a["side"][1:] != a["side"][:-1]) | (a["label"][1:] != a["label"][:-1])])
    side_edge = np.concatenate([[True], edge[1:] | (a["side"][1:] != a["side"][:-1])])
    after = np.append(np.flatnonzero(run)[1:], n)[np.cumsum(run) - 1]
    greater = np.append(np.flatnonzero(side_edge)[1:], n)[np.cumsum(side_edge) - 1]
    start = np.where(a["side"] == 0, after, np.where(a["side"] == 1, greater, stop))
    count = np.maximum(stop - start, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < n:
        k = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, side="right")) - 1)
        c = count[i:k]
        if c.any():
            x = np.repeat(np.arange(i, k), c)
            y = np.arange(len(x)) - np.repeat(total[i:k] - total[i], c) + np.repeat(start[i:k], c)
            ok = (a["label"][x] != a["label"][y]) & (a["doc"][x] != a["doc"][y]) & ((a["row"][x] != PLAIN) | (a["row"][y] != PLAIN))
            p = _ordered(_joined(a[x[ok]], a[y[ok]]))
            if len(p):
                yield _dealt(_pair_part(p["a"], p["b"], parts), p, 0)
        i = k


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n: at most how many pairs the cells of a partition give."""
    a = _read(batches, CELL)
    a = a[np.argsort(a["cell"], kind="stable")]
    a = a[_open(a, "cell")] if len(a) else a
    if len(a):
        _, which = np.unique(a["cell"], return_inverse=True)
        n = [np.bincount(which, a["side"] == s) for s in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([int((n[0] * (n[0] - 1) / 2 + n[1] * n[2]).sum())], pa.int64())], names=["n"])


def pairs_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n: at most how many pairs the hashes with two classes of a partition give."""
    a = _read(batches, LABELLED)
    a = a[np.argsort(a["hash"], kind="stable")]
    a = a[_open(a)] if len(a) else a
    if len(a):
        _, which = np.unique(a["hash"], return_inverse=True)
        n, plain = np.bincount(which).astype(np.int64), np.bincount(which, a["row"] == PLAIN).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int((n * (n - 1) // 2 - plain * (plain - 1) // 2).sum())], pa.int64())], names=["n"])


def candidates(batches: Iterator[pa.RecordBatch], parts: int, need: int, best: bool) -> Iterator[pa.RecordBatch]:
    """Where the windows of a pair of texts overlap `need` times along near diagonals: asks for both passages.

    best: of each pair of texts only the place with most windows; else places all along, HALF words apart.
    """
    p = _read(batches, PAIR)
    if not len(p):
        return
    asks = []
    p = p[np.lexsort((p["b"], p["a"]))]
    number = np.cumsum(np.concatenate([[False], (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])])).astype(np.int64)
    for shift in (0, NEAR // 2):
        key = number * (1 << 32) + (p["delta"].astype(np.int64) + shift) // NEAR
        _, group = np.unique(key, return_inverse=True)
        of_group = np.zeros(group.max() + 1, np.int64)
        of_group[group] = number
        base = group.astype(np.int64) << 32
        lo, hi = base + p["lo"], base + p["hi"]
        places, count = cover(lo, hi)
        ok = count >= need
        if not ok.any():
            continue
        if best:
            at = np.flatnonzero(ok)
            pair = of_group[places[at] >> 32]
            at = at[np.lexsort((-at, count[at], pair))]
            pair = of_group[places[at] >> 32]
            at = at[np.concatenate([pair[1:] != pair[:-1], [True]])]
            start = (places[at] + places[at + 1] - 1) // 2
            votes = count[at]
        else:
            begin = np.flatnonzero(ok & ~np.concatenate([[False], ok[:-1]]))
            end = np.flatnonzero(ok & ~np.concatenate([ok[1:], [False]]))
            first, steps = places[begin], -(-(places[end + 1] - places[begin]) // HALF)
            start = np.repeat(first, steps) + HALF * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
            votes = np.zeros(len(start), np.int64)
        order = np.argsort(lo, kind="stable")
        near = order[np.searchsorted(lo[order], start, side="right") - 1]  # the last window that begins there or before
        out = np.zeros(len(start), PAIR)
        out["a"], out["b"], out["delta"], out["j"] = p["a"][near], p["b"][near], p["delta"][near], np.minimum(votes, 255)
        out["lo"] = start & 0xFFFFFFFF
        asks.append(out)
    if not asks:
        return
    q = np.unique(np.concatenate(asks))
    if best:
        q = q[np.lexsort((q["j"], q["b"], q["a"]))]
        q = q[np.concatenate([(q["a"][1:] != q["a"][:-1]) | (q["b"][1:] != q["b"][:-1]), [True]])]
    with np.errstate(over="ignore"):
        key = _mix(_mix(np.ascontiguousarray(q["a"]).view(np.uint64)) + _M[0] * _mix(np.ascontiguousarray(q["b"]).view(np.uint64)) + _M[5] * q["lo"].astype(np.uint64) + _M[6] * q["delta"].astype(np.uint64))
    both = []
    for side, doc, at in ((0, q["a"], q["lo"].astype(np.int64)), (1, q["b"], q["lo"].astype(np.int64) + q["delta"])):
        out = np.zeros(len(q), ASK)
        before = np.minimum(np.minimum(q["lo"], q["lo"].astype(np.int64) + q["delta"]), HALF)
        out["key"], out["doc"], out["side"], out["lo"], out["n"] = key, doc, side, at - before, before + HALF + PASSAGE
        both.append(out)
    out = np.concatenate(both)
    yield _dealt(_doc_part(out["doc"], parts), out, 0)


def distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, bytes) without the texts that the task has sent already: a group of copies is sent once a task."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for doc in batch.column(0).to_pylist():
            fresh.append(doc not in seen)
            seen.add(doc)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Closed intervals, ascending by lo, united where they meet."""
    top = np.maximum.accumulate(hi)
    cut = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1] + 1]))
    return list(zip(lo[cut].tolist(), top[np.append(cut[1:], len(lo)) - 1].tolist(), strict=True))


def regions(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words of passages with AGREE windows, and half a window more on either side; dealt by text, kind 2."""
    done: set[int] = set()
    held: dict[int, list[tuple[int, int, int, bytes]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(part, _pack_regions(some)) for part, some in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([2] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "kind", "blob"])

    for (doc, _, text), own in _with_texts(batches, NODE):
        if not len(own) or doc in done:
            continue
        done.add(doc)
        places, count = cover(own["lo"].astype(np.int64), own["lo"].astype(np.int64) + own["span"])
        ok = np.flatnonzero(count >= AGREE)
        if not len(ok):
            continue
        starts, ends = word_places(text)
        runs = _merged(np.maximum(places[ok] - STARTS, 0), np.minimum(places[ok + 1] - 1 + HALF + PASSAGE, len(starts)) - 1)
        part = int(_doc_part(np.array([doc]), parts)[0])
        for lo, hi in runs:
            words_ = text[starts[lo] : ends[hi]]
            held.setdefault(part, []).append((doc, lo, hi - lo + 1, words_))
            size += len(words_)
        if size > 1 << 22:
            yield from out()
            held, size = {}, 0
    yield from out()


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    starts, ends = [], []
    for at in range(0, len(text), 1 << 22):
        inside = ~_SPACE[np.frombuffer(text[max(0, at - 1) : at + (1 << 22)], np.uint8)]
        before = inside[:-1] if at else np.concatenate([[False], inside[:-1]])
        here = inside[1:] if at else inside
        starts.append(np.flatnonzero(here & ~before) + at)
        ends.append(np.flatnonzero(before & ~here) + at)
    if len(text) and not _SPACE[text[-1]]:
        ends.append(np.array([len(text)]))
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64),) * 2


def _pack_regions(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    head = np.array([(doc, lo, n, len(x)) for doc, lo, n, x in rows], REGION)
    return len(rows).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(x[3] for x in rows))


def _read_regions(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(regions ascending by text and place, the place of each one's first word in the hashes, hashes of all words)."""
    heads, parts = [], []
    for blob in blobs:
        n, raw = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:])
        head = np.frombuffer(raw, REGION, count=n)
        at = REGION.itemsize * n + np.cumsum(np.concatenate([[0], head["size"].astype(np.int64)]))
        heads.append(head)
        parts += [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
    head = np.concatenate(heads)
    order = np.lexsort((head["lo"], head["doc"]))
    head = head[order]
    begin = np.concatenate([[0], np.cumsum(head["words"].astype(np.int64))])
    return head, begin, hashes_of(b"\n".join(parts[i] for i in order.tolist()))


def _by_part(batches: Iterator[pa.RecordBatch], dtypes: tuple[np.dtype, ...]) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    """Rows sorted by part: the part, its arrays of each kind, and its regions (kind 2)."""
    part, held, blobs = None, [[] for _ in dtypes], []

    def read() -> tuple[int, list[np.ndarray], list[bytes]]:
        return part, [np.concatenate(h) if h else np.zeros(0, d) for h, d in zip(held, dtypes, strict=True)], blobs

    for batch in slices(batches):
        for p, kind, blob in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if p != part:
                if part is not None:
                    yield read()
                part, held, blobs = p, [[] for _ in dtypes], []
            if kind == 2:
                blobs.append(blob)
            else:
                held[kind].append(unpack(blob, dtypes[kind]))
    if part is not None:
        yield read()


def _find(head: np.ndarray, begin: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where words lo of texts doc lie among the regions' words; -1 where no region has them."""
    _, codes = np.unique(np.concatenate([head["doc"], doc]), return_inverse=True)
    own = codes[: len(head)].astype(np.int64) * (1 << 33) + head["lo"]
    at = np.searchsorted(own, codes[len(head) :].astype(np.int64) * (1 << 33) + lo, side="right") - 1
    at0 = np.maximum(at, 0)
    inside = (at >= 0) & (head["doc"][at0] == doc) & (lo < head["lo"][at0].astype(np.int64) + head["words"][at0])
    return np.where(inside, begin[at0] + lo - head["lo"][at0], -1)


def passages(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The shingle hashes of the asked passages, dealt by the ask's key: (part, key, side, doc, shingles)."""
    for _, (asks,), blobs in _by_part(batches, (ASK,)):
        if not len(asks) or not blobs:
            continue
        asks = np.unique(asks)
        head, begin, w = _read_regions(blobs)
        s = shingle_hashes(w)
        at = _find(head, begin, asks["doc"], asks["lo"].astype(np.int64))
        asks, at = asks[at >= 0], at[at >= 0]
        end = begin[np.searchsorted(begin, at, side="right")]
        last = np.minimum(at + asks["n"], end) - SHINGLE + 1
        for i in range(0, len(asks), 2048):
            some, rows = asks[i : i + 2048], [s[a:b].tobytes() for a, b in zip(at[i : i + 2048].tolist(), last[i : i + 2048].tolist(), strict=True)]
            key = np.ascontiguousarray(some["key"])
            yield pa.RecordBatch.from_arrays([pa.array(_hash_part(key, parts), pa.int64()), pa.array(key.view(np.int64), pa.int64()), pa.array(some["side"].astype(np.int32), pa.int32()), pa.array(some["doc"], pa.int64()), pa.array(rows, pa.binary())], names=["part", "key", "side", "doc", "shingles"])


# -- what the first star leaves ----------------------------------------------------------------------------------------
def _alive(head: np.ndarray, begin: np.ndarray, n: int, a: np.ndarray) -> np.ndarray:
    """Which places among the regions' words are starts of passages with AGREE of the windows a."""
    lo = _find(head, begin, a["doc"], a["lo"].astype(np.int64))
    a, lo = a[lo >= 0], lo[lo >= 0]
    step = np.bincount(lo, minlength=n + 1) - np.bincount(np.minimum(lo + a["span"] + 1, n), minlength=n + 1)
    out = np.cumsum(step)[:n] >= AGREE
    whole = np.zeros(n, bool)
    end = np.repeat(begin[1:], np.diff(begin))
    whole[: len(end)] = np.arange(len(end)) + PASSAGE <= end
    return out & whole


def ask_shingles(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The shingles of the passages that are left in each part, with the classes of their texts, dealt by shingle."""
    for part, (a, labels), blobs in _by_part(batches, (NODE, LABEL)):
        if not len(a) or not blobs:
            continue
        head, begin, w = _read_regions(blobs)
        s = shingle_hashes(w)
        starts = np.flatnonzero(_alive(head, begin, len(w), a))
        held = np.bincount(starts, minlength=len(w) + STARTS + 1) - np.bincount(starts + STARTS, minlength=len(w) + STARTS + 1)
        at = np.flatnonzero(np.cumsum(held)[: len(s)] > 0)
        if len(at):
            doc = head["doc"][np.searchsorted(begin, at, side="right") - 1]
            out = _asked(s[at] & ~np.uint64(0xFFFF), doc, _labels_of(doc, labels), part)
            yield _dealt(_hash_part(out["hash"], parts), out, 0)


def rare_windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The windows of the rarest shingles of the passages whose shingles other classes have, dealt by text.

    A passage without repeated shingles must share FULL of them with another such, so it has STARTS - FULL of its own at
    most, and one of the first STARTS - FULL + 1 in order of frequency is shared. A passage of n different shingles
    must share 4 in 5 of them with any. Three tables, by the last digits of the hash:

    0: passages without repeats among themselves.
    1: passages with some repeats (n is 4 in 5 of STARTS or more, marked REPEATS) among themselves and with those
       without (PLAIN). Here as in 0 a window is a shingle's place with the starts of the passages around it.
    2: passages with more repeats (REPEATS) among themselves and with those of some repeats (PLAIN). A window is the
       passage itself, and of passages of one text with equal sets of shingles only the first is taken.
    """
    for _, (a, often), blobs in _by_part(batches, (NODE, ANSWER)):
        if not len(a) or not len(often) or not blobs:
            continue
        often = often[np.argsort(often["hash"])]
        head, begin, w = _read_regions(blobs)
        s = shingle_hashes(w)
        n = len(w)
        place = np.minimum(np.searchsorted(often["hash"], s & ~np.uint64(0xFFFF)), len(often) - 1)
        texts = np.where(often["hash"][place] == s & ~np.uint64(0xFFFF), np.minimum(np.maximum(often["texts"][place], 2), 65535), 1)  # 1: no other class has it
        key = np.zeros(n, np.uint64)
        key[: len(s)] = (texts.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))
        order = np.argsort(s, kind="stable")
        again = np.zeros(n, np.int64)  # a shingle that came less than a passage ago
        close = (s[order][1:] == s[order][:-1]) & (np.diff(order) < STARTS)
        again[order[1:][close]] = 1
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        alone, repeats = total(np.append(texts == 1, np.zeros(n - len(s), bool))), total(again)
        starts = np.flatnonzero(_alive(head, begin, n, a))
        most = STARTS - math.ceil(SIMILAR * STARTS)
        starts = starts[alone[starts + STARTS] - alone[starts] <= most + repeats[starts + STARTS] - repeats[starts]]
        found, sets = [], []
        for i in range(0, len(starts), 4096):
            some = starts[i : i + 4096]
            view = np.lib.stride_tricks.sliding_window_view(key, STARTS)[some]
            rank = np.argsort(view, axis=1, kind="stable")
            ordered = np.take_along_axis(view, rank, axis=1)
            fresh = np.concatenate([np.ones((len(some), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
            size = fresh.sum(axis=1)
            number = np.cumsum(fresh, axis=1)  # of different shingles so far
            single = (ordered >> np.uint64(48)) == 1
            own, free = (single & fresh).sum(axis=1), size - np.ceil(SIMILAR * size - 1e-9).astype(np.int64)
            plain, few = size == STARTS, (size < STARTS) & (size >= STARTS - most)
            for table, mark, rows, first in ((0, 0, plain & (own <= STARTS - FULL), np.full(len(some), STARTS - FULL + 1)), (1, REPEATS, few & (own <= free), free + 1), (1, PLAIN, plain & (own <= most), np.full(len(some), most + 1))):
                r, c = np.nonzero(rows[:, None] & (number <= first[:, None]) & ~single)
                found.append(np.stack([np.full(len(r), table), np.full(len(r), mark), some[r] + rank[r, c], some[r]]))
            rows = np.flatnonzero(~plain & (own <= free))
            if len(rows):
                with np.errstate(over="ignore"):
                    of_set = np.where(fresh[rows], _mix(ordered[rows]), np.uint64(0)).sum(axis=1, dtype=np.uint64)
                r, c = np.nonzero((number[rows] <= (free[rows] + 1)[:, None]) & fresh[rows] & ~single[rows])
                sets.append(np.stack([np.where(few[rows[r]], PLAIN, REPEATS), some[rows[r]] + rank[rows[r], c], some[rows[r]], of_set[r].view(np.int64)]))
        parts_ = []
        if found:
            table, mark, place, start = np.concatenate(found, axis=1)
            order = np.lexsort((start, place, mark, table))
            table, mark, place, start = table[order], mark[order], place[order], start[order]
            change = np.concatenate([[True], (table[1:] != table[:-1]) | (mark[1:] != mark[:-1]) | (place[1:] != place[:-1])])[: len(mark)]
            cut = np.flatnonzero(change)
            if len(cut):
                lo = start[cut]
                parts_.append((table[cut], mark[cut], place[cut], lo, start[np.append(cut[1:], len(start)) - 1] - lo, place[cut] - lo))
        if sets:
            mark, place, start, of_set = np.concatenate(sets, axis=1)
            doc = head["doc"][np.searchsorted(begin, start, side="right") - 1]
            order = np.lexsort((start, of_set, doc))
            change = np.concatenate([[True], (of_set[order][1:] != of_set[order][:-1]) | (doc[order][1:] != doc[order][:-1])])[: len(order)]
            first = np.repeat(start[order][change], np.diff(np.append(np.flatnonzero(change), len(order))))
            keep = order[start[order] == first]
            parts_.append((np.full(len(keep), 2), mark[keep], place[keep], start[keep], np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)))
        if not parts_:
            continue
        table, mark, place, lo, span, at = (np.concatenate(x) for x in zip(*parts_, strict=True))
        if not len(lo):
            continue
        own = np.searchsorted(begin, lo, side="right") - 1
        out = np.zeros(len(lo), NODE)
        out["hash"] = (s[place] & ~np.uint64(0xFFFF)) | table.astype(np.uint64)
        out["doc"], out["lo"], out["span"], out["at"], out["row"] = head["doc"][own], head["lo"][own] + lo - begin[own], span, at, mark
        yield _dealt(_doc_part(out["doc"], parts), out, 0)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Is a passage of x like the one at the same place of y?"""
    n = min(len(x), len(y))
    if n < STARTS:
        return False
    x, y = x[:n], y[:n]
    places = np.arange(n - STARTS + 1)
    if len(np.unique(x)) == n and len(np.unique(y)) == n:  # without repeats, at most a fifth may be missing
        need = math.ceil(STARTS * 2 * SIMILAR / (1 + SIMILAR) - 1e-9)
        for own, other in ((x, y), (y, x)):
            here = np.concatenate([[0], np.cumsum(np.isin(own, other))])
            places = places[here[places + STARTS] - here[places] >= need]
    for i in places.tolist():
        a, b = set(x[i : i + STARTS].tolist()), set(y[i : i + STARTS].tolist())
        both = len(a & b)
        if both >= SIMILAR * (len(a) + len(b) - both):
            return True
    return False


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, tuple[int, int, bytes]] = {}
    for batch in batches:
        out = []
        for key, side, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if key not in waiting:
                waiting[key] = (side, doc, raw)
            elif waiting[key][0] != side:
                _, other, own = waiting.pop(key)
                if similar(np.frombuffer(own, np.uint64), np.frombuffer(raw, np.uint64)):
                    out.append((min(doc, other), max(doc, other)))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, doc, long_enough; verified links a, b between texts, named by the hash of the text)."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), F.lit(0).cast("long").alias("row"), text.cast("binary").alias("bytes"), text.alias("text"))
    size = rows.agg(F.sum(F.length("bytes"))).first()[0] or 0
    tasks = max(1, -(-size // (8 << 20)))
    parts = 4 * tasks
    texts = rows.select("doc", "row", "bytes")

    def dealt(src: DataFrame, fn, tasks: int = tasks) -> DataFrame:
        return src.repartition(tasks, "part").mapInArrow(fn, BLOB)

    def together(*src: DataFrame, tasks: int = tasks) -> DataFrame:
        every = src[0]
        for x in src[1:]:
            every = every.unionByName(x)
        return every.repartition(tasks, "part").sortWithinPartitions("part", "kind")

    first = written(dealt(texts.mapInArrow(lambda it: find_windows(it, parts), BLOB), lambda it: shared(it, parts)))
    kept = written(dealt(first, lambda it: agreeing(it, parts)))
    discard(first)
    around = written(with_texts(texts.mapInArrow(distinct_texts, "doc long, row long, bytes binary"), kept, parts, tasks).mapInArrow(lambda it: regions(it, parts), BLOB))

    def checked(pairs: DataFrame, need: int, best: bool, parts: int = parts, tasks: int = tasks) -> DataFrame:
        asks = pairs.repartition(tasks, "part").mapInArrow(lambda it: candidates(it, of_texts, need, best), BLOB)
        got = together(asks, around, tasks=tasks).mapInArrow(lambda it: passages(it, parts), "part long, key long, side int, doc long, shingles binary")
        return got.repartition(tasks, "part").sortWithinPartitions("key", "side").mapInArrow(verified, "a long, b long")

    of_texts = parts

    def labels(found: DataFrame) -> DataFrame:
        return written(connected(found, "a", "b", AT_ONCE).mapInArrow(lambda it: pack_labels(it, parts), BLOB))

    def starred(windows_: DataFrame, known: DataFrame | None, turn: int = 0, tasks: int = tasks) -> DataFrame:
        need = known is None  # rare shingles are few, and their stars settle what is left of a text
        own = written(dealt(windows_ if need else windows_.unionByName(known), lambda it: local_stars(it, parts, need, turn), tasks))
        return own.filter("kind = 0").unionByName(dealt(own.filter("kind = 1"), lambda it: stars(it, parts, turn), tasks))

    found = written(checked(starred(kept, None), AGREE, True).distinct())
    known = labels(found)
    two = dealt(together(kept, known).mapInArrow(lambda it: ask_windows(it, parts), BLOB), answers)
    rest = written(together(kept, two).mapInArrow(lambda it: open_windows(it, parts), BLOB))
    often = dealt(together(rest, known, around).mapInArrow(lambda it: ask_shingles(it, parts), BLOB), answers)
    rare = written(together(rest, often, around).mapInArrow(lambda it: rare_windows(it, parts), BLOB))
    packed = rare.agg(F.sum(F.length("blob"))).first()[0] or 0
    if packed:
        few = min(tasks, max(FEW, -(-packed // PACKED)))
        for turn in range(TURNS):
            found = written(found.unionByName(checked(starred(rare, known, turn, few), 1, True, parts, few)).distinct())
            known = labels(found)
            by_hash = dealt(rare.unionByName(known), lambda it: named(it, parts), few)
            pairs = by_hash.repartition(few, "part").mapInArrow(pairs_left, "n long").agg(F.sum("n")).first()[0] or 0
            if pairs <= MANY * tasks:
                break
        if pairs:
            cells = written(dealt(by_hash, lambda it: spread(it, parts), few))
            pairs = cells.repartition(few, "part").mapInArrow(pair_counts, "n long").agg(F.sum("n")).first()[0] or 0
            more = max(few, -(-pairs // CHUNK))
            every = cells.repartition(min(more, parts), "part").mapInArrow(lambda it: all_pairs(it, 4 * more), BLOB)
            found = written(found.unionByName(checked(every, 1, False, 4 * more, more)).distinct())
    some = F.filter(F.split("text", SPLIT, PASSAGE + 2), lambda w: w != "")  # counting stops there
    return rows.select("doc_id", "doc", (F.size(some) >= PASSAGE).alias("long_enough")), found


def classes(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, class_id of each row."""
    rows, found = links(df, text_col)
    rows = written(rows)
    label = written(connected(found, "a", "b", AT_ONCE))
    texts = rows.filter("long_enough").groupBy("doc").agg(F.min("doc_id").alias("least")).join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    ids = texts.groupBy("label").agg(F.min("least").alias("class"))
    of_text = texts.join(ids, "label").select("doc", "class")
    out = rows.join(of_text, "doc", "left")
    own = F.when(F.col("long_enough"), F.col("class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"))
