"""Exact substring deduplication by bucket-pointer refinement of a distributed suffix array.

What goes: every byte covered by a string of `LENGTH` bytes that also starts in a document with a smaller doc_id.

1. Anchors. Every window of LENGTH bytes holds W q-grams; the one with the least hash (the first of equals) is its
   anchor. Equal windows have equal anchors at equal places, so only windows whose anchor occurs in two documents can
   count. Windows with one anchor are neighbours: a *piece* is the text that they cover, some 15 bytes longer than
   LENGTH. Each batch of texts sends an anchor hash at most once; anchors found twice within the batch are candidates
   already, the others become candidates if another batch has sent the same hash.
2. Pieces. The candidates go back to their texts, and the pieces are dealt by anchor hash. Equal pieces are merged
   first (in the batch and again after the shuffle): all but the least doc_id go wholly, so large groups of copies
   shrink before any sorting.
3. Refinement. The suffixes of the pieces are put into buckets by their first 8 bytes; a bucket's number is then
   refined by sorting on the pair (own bucket, bucket of the suffix 8 bytes on), which orders 16 bytes; the updated
   numbers are used again for 32 and, overlapping, for LENGTH bytes. Singleton buckets drop out at each step. Windows
   in one final bucket are equal; those above the bucket's least doc_id go.
4. The removed intervals go back to their texts and are united.

Texts move twice, dealt by doc_id; everything else is packed arrays. All steps are exact: hashes only choose what is
compared. A task holds one batch (BATCH bytes of text) or one partition of packed anchors or pieces.

Defined results: null text is empty, nothing is removed from texts under LENGTH bytes; a string repeated within one
document only stays; rows with equal doc_id do not remove each other's bytes; a null doc_id counts as larger than all
others (2 ** 63 - 1, which stands for it, is the one number that counts as null); an empty table gives an empty table;
extra columns are ignored by `digests` and kept by `deduplicate`, whose own columns make way for columns of the same
name and whose texts lose what is left of a character that was cut in two. A row is known by its doc_id and its text's
64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm._common import discard, free_prefix, named, slices, written

LENGTH, Q = 50, 20
W = LENGTH - Q + 1
BATCH = 4 << 20
LAST = (1 << 63) - 1  # stands for a null doc_id
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("span", "u1"), ("known", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
RUN = 1 << 19  # bytes of text that are hashed at once
WORK = 3 << 18  # bytes of pieces that are sorted at once


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes that start at each place (len(b) - Q + 1 of them)."""
    with np.errstate(over="ignore"):
        h = (b.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        h ^= h >> np.uint64(29)
        parts, size = {1: h}, 1
        while size * 2 <= Q:
            h = h[:-size] * _MIX[size.bit_length()] + h[size:]
            size *= 2
            parts[size] = h
        out, at = parts[size], size
        while at < Q:
            size = 1 << ((Q - at).bit_length() - 1)
            more = parts[size][at:]
            n = len(b) - at - size + 1
            out = out[:n] * _MIX[5] + more[:n]
            at += size
        out ^= out >> np.uint64(31)
        out *= _MIX[1]
        out ^= out >> np.uint64(30)
    return out


def anchors(b: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of the texts b[starts[i]:ends[i]]."""
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none.astype(np.uint64), none, none
    h = gram_hashes(b)
    place = np.uint64((1 << 24) - 1)
    m = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= W:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < W:
        m = np.minimum(m[: len(m) - (W - size)], m[W - size :])
    valid = np.zeros(len(m) + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    p = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    if not len(p):
        return none.astype(np.uint64), none, none
    a = m[p] & place
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    return h[a[cut].astype(np.int64)], p[cut], p[np.append(cut[1:], len(p)) - 1]


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """(doc, row, texts as bytes, extra) of about BATCH bytes."""
    docs, rows, texts, extra, size = [], [], [], [], 0
    for batch in slices(batches):
        more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for doc, row, text, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), more, strict=True):
            if size + len(text) > BATCH and docs:
                yield docs, rows, texts, extra
                docs, rows, texts, extra, size = [], [], [], [], 0
            docs.append(doc)
            rows.append(row)
            texts.append(text)
            extra.append(x)
            size += len(text)
    if docs:
        yield docs, rows, texts, extra


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), ends, ends - sizes


def _two_docs(hashes: np.ndarray, docs: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """For each entry: does its hash come with two doc_ids, or with a known one?"""
    order = np.lexsort((docs, hashes))
    hs, ds = hashes[order], docs[order]
    first = np.concatenate([[True], hs[1:] != hs[:-1]])
    group = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(hs)) - 1
    both = ds[begin] != ds[end]
    if known is not None:
        both |= np.maximum.reduceat(known[order], begin) > 0
    out = np.empty(len(hashes), bool)
    out[order] = both[group]
    return out


def pack(rows: np.ndarray) -> bytes:
    """A structured array, field by field, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names))


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.zeros(len(raw) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        size = len(out) * dtype[f].itemsize
        out[f] = np.frombuffer(raw, dtype[f], offset=at, count=len(out))
        at += size
    return out


def _dealt(part: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """(part, kind, blob): one row for each value of part, with its rows packed."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    blobs = [pack(x) for x in np.split(rows, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array([kind] * len(cut), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def _doc_part(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part of a document; doc_part_column is the same for a column."""
    d = docs.astype(np.int64)
    return (d ^ (d >> 17) ^ (d >> 41)) % parts


def doc_part_column(doc, parts: int):
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(F.shiftright(doc, 41)), F.lit(parts))


def _hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def find_anchors(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: anchors to look up, dealt by hash. Kind 1: candidates that the batch settles, dealt by document."""
    for docs, rows, texts, _ in _in_batches(batches):
        runs, i = [], 0
        while i < len(texts):  # hashing needs some 60 bytes for each byte of text: take RUN bytes at a time
            k, size = i, 0
            while k < len(texts) and (k == i or size + len(texts[k]) <= RUN):
                size += len(texts[k])
                k += 1
            if size <= 2 * RUN:
                runs.append((*_layout(texts[i:k]), np.arange(i, k), np.zeros(k - i, np.int64)))
            else:  # a very long text is cut, with LENGTH - 1 bytes of overlap
                for at in range(0, size - LENGTH + 1, RUN - LENGTH + 1):
                    runs.append((*_layout([texts[i][at : at + RUN]]), np.array([i]), np.array([at])))
            i = k
        found = []
        for bb, ee, ss, own, shift in runs:
            h, lo, hi = anchors(bb, ee, ss)
            d = np.searchsorted(ee, lo, side="right")
            out = np.zeros(len(h), ANCHOR)
            out["hash"], out["doc"], out["row"] = h & ~np.uint64(0xFFFF), np.array(docs, np.int64)[own[d]], np.array(rows, np.int64)[own[d]]
            out["lo"], out["span"] = lo - ss[d] + shift[d], hi - lo
            found.append(out)
        out = np.concatenate(found)
        if not len(out):
            continue
        twice = _two_docs(out["hash"], out["doc"])
        if twice.any():
            settled = out[twice]
            yield _dealt(_doc_part(settled["doc"], parts), settled, 1)
            _, first = np.unique(settled["hash"], return_index=True)
            one = settled[first]  # one for the batch, to tell the others
            one["known"] = 1
            out = np.concatenate([out[~twice], one])
        yield _dealt(_hash_part(out["hash"], parts), out, 0)


def confirm(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All candidates, dealt by document (part, kind 0, blob)."""
    held = []
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                held.append(unpack(blob, ANCHOR))
            else:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])
    if held:
        a = np.concatenate(held)
        a = a[_two_docs(a["hash"], a["doc"], a["known"]) & (a["known"] == 0)]
        if len(a):
            yield _dealt(_doc_part(a["doc"], parts), a, 0)


def _with_texts(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows sorted by part, packed arrays (kind 0) before texts: each text with its own entries of the arrays."""
    part, held, index = None, [], None
    for batch in slices(batches):
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols, strict=True):
            if row[0] != part:
                part, held, index = row[0], [], None
            if row[1] == 0:
                held.append(unpack(row[2], dtype))
                continue
            if index is None:
                all_ = np.concatenate(held) if held else np.zeros(0, dtype)
                all_ = all_[np.lexsort((all_["lo"], all_["row"], all_["doc"]))]
                cut = np.flatnonzero(np.concatenate([[True], (all_["doc"][1:] != all_["doc"][:-1]) | (all_["row"][1:] != all_["row"][:-1])])) if len(all_) else []
                index = dict(zip(zip(all_["doc"][cut].tolist(), all_["row"][cut].tolist(), strict=True), np.split(all_, cut[1:]), strict=True)) if len(all_) else {}
                held = []
            yield row[3:], index.get((row[3], row[4]), np.zeros(0, dtype))


PIECE = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("size", "u1")])


class _Pieces:
    """Distinct pieces. Of equal ones only those of the least doc_id stay; the others are removed at once."""

    def __init__(self):
        self.seen: dict[tuple[int, bytes], list] = {}  # (hash, text) -> [doc, places of (row, lo)]
        self.gone: list[tuple[int, int, int, int]] = []

    def add(self, h: int, text: bytes, doc: int, row: int, lo: int) -> None:
        old = self.seen.get((h, text))
        if old is None:
            self.seen[h, text] = [doc, [(row, lo)]]
        elif doc == old[0]:
            old[1].append((row, lo))
        elif doc > old[0]:
            self.gone.append((doc, row, lo, lo + len(text)))
        else:
            self.gone += [(old[0], r, x, x + len(text)) for r, x in old[1]]
            self.seen[h, text] = [doc, [(row, lo)]]

    def packed(self, parts: int) -> Iterator[pa.RecordBatch]:
        rows = [(h, doc, r, lo, len(t), t) for (h, t), (doc, places) in self.seen.items() for r, lo in places]
        if rows:
            table = np.array([x[:5] for x in rows], PIECE)
            part = _hash_part(table["hash"], parts)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
            blobs = []
            for own in np.split(order, cut[1:]):
                blobs.append(len(own).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join([*(table[f][own].tobytes() for f in PIECE.names), *(rows[i][5] for i in own.tolist())])))
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cut], pa.int64()), pa.array([0] * len(cut), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def removed(self, parts: int) -> Iterator[pa.RecordBatch]:
        if self.gone:
            gone = np.array(self.gone, SPAN)
            yield _dealt(_doc_part(gone["doc"], parts), gone, 1)

    def read(self, blob: bytes) -> None:
        n, raw, at, cols = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:]), 0, []
        for f in PIECE.names:
            cols.append(np.frombuffer(raw, PIECE[f], offset=at, count=n).tolist())
            at += n * PIECE[f].itemsize
        for h, doc, row, lo, size in zip(*cols, strict=True):
            self.add(h, raw[at : at + size], doc, row, lo)
            at += size


def cut_pieces(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: pieces dealt by anchor hash. Kind 1: intervals that the batch removes, dealt by document."""
    pieces, size = _Pieces(), 0
    for (doc, row, text), own in _with_texts(batches, ANCHOR):
        for h, lo, span in zip(own["hash"].tolist(), own["lo"].tolist(), own["span"].tolist(), strict=True):
            pieces.add(h, text[lo : lo + span + LENGTH], doc, row, lo)
        size += 64 * len(own)
        if size > BATCH:
            yield from pieces.packed(parts)
            yield from pieces.removed(parts)
            pieces, size = _Pieces(), 0
    yield from pieces.packed(parts)
    yield from pieces.removed(parts)


def refine(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, last window) of the windows that also start in a piece of a smaller document.

    Bucket-pointer refinement: buckets by 8 bytes, then by pairs of bucket numbers 8, 16 and LENGTH - 32 bytes apart.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    grams = np.lib.stride_tricks.sliding_window_view(b, 8).copy().view(">u8").ravel()[:-1].astype(np.uint64)
    _, number, count = np.unique(grams, return_inverse=True, return_counts=True)
    single = count[number] == 1
    open_ = np.ones(len(b), np.int8)
    open_[np.concatenate([np.arange(e - LENGTH + 1, e) for e in ends.tolist()])] = 0  # no whole window starts there
    p = np.flatnonzero(open_[: ends[-1]])
    for k in (0, 8, 16, 24, 32, 40, 42):  # a window with a gram that occurs once is alone
        p = p[~single[p + k]]
    if not len(p):
        return np.zeros(0, np.int64), p, p

    def paired(numbers: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(len(b), np.int64)
        out[at] = np.unique((numbers[at].astype(np.uint64) << np.uint64(32)) | numbers[at + step].astype(np.uint64), return_inverse=True)[1]
        return out

    at32 = np.union1d(p, p + LENGTH - 32)
    at16 = np.union1d(at32, at32 + 16)
    by16 = paired(number, at16, 8)
    by32 = paired(by16, at32, 16)
    final = paired(by32, p, LENGTH - 32)[p]
    own = np.searchsorted(ends, p, side="right")
    least = np.full(final.max() + 1, LAST, np.int64)
    np.minimum.at(least, final, docs[own])
    hit = docs[own] > least[final]
    p, own = p[hit], own[hit]
    if not len(p):
        return own, p, p
    cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (own[1:] != own[:-1])]))
    first, last = p[cut], p[np.append(cut[1:], len(p)) - 1]
    begin = ends[own[cut]] - sizes[own[cut]]
    return own[cut], first - begin, last - begin


def sort_pieces(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Removed intervals, dealt by document (part, kind 0, blob)."""
    pieces = _Pieces()
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                pieces.read(blob)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])
    by_hash: dict[int, list] = {}
    for (h, text), (doc, places) in pieces.seen.items():
        by_hash.setdefault(h, []).append((text, doc, places))
    work, size = [], 0
    for h in list(by_hash):
        group = by_hash.pop(h)
        if len(group) > 1:
            work += group
            size += sum(len(x[0]) for x in group)
        if size > WORK or (work and not by_hash):
            for i, first, last in zip(*(x.tolist() for x in refine([x[0] for x in work], np.array([x[1] for x in work], np.int64))), strict=True):
                pieces.gone += [(work[i][1], r, lo + first, lo + last + LENGTH) for r, lo in work[i][2]]
            work, size = [], 0
    if pieces.gone:
        gone = np.array(pieces.gone, SPAN)
        yield _dealt(_doc_part(gone["doc"], parts), gone, 0)


def united(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the intervals (ascending by lo)."""
    if not len(spans):
        return []
    lo, hi = spans["lo"].astype(np.int64), np.maximum.accumulate(spans["hi"].astype(np.int64))
    cut = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[cut].tolist(), hi[np.append(cut[1:], len(lo)) - 1].tolist(), strict=True))


def removed_spans(rows: DataFrame) -> tuple[DataFrame, int]:
    """Packed removed intervals of rows (doc, row, bytes), and the number of parts they are dealt into."""
    size = rows.agg(F.sum(F.length("bytes"))).first()[0] or 0
    tasks = max(1, -(-size // (8 << 20)))
    parts = 4 * tasks
    blobs = "part long, kind int, blob binary"
    sent = rows.mapInArrow(lambda it: find_anchors(it, parts), blobs)
    candidates = written(sent.repartition(tasks, "part").mapInArrow(lambda it: confirm(it, parts), blobs))
    cut = with_texts(rows, candidates, parts, tasks).mapInArrow(lambda it: cut_pieces(it, parts), blobs)
    spans = written(cut.repartition(tasks, "part").mapInArrow(lambda it: sort_pieces(it, parts), blobs))
    discard(candidates)
    return spans, parts


def with_texts(rows: DataFrame, packed: DataFrame, parts: int, tasks: int) -> DataFrame:
    """part, kind, blob, doc, row, bytes: packed arrays and the texts of their documents, a part together."""
    with_part = rows.withColumn("part", doc_part_column(F.col("doc"), parts))
    texts = with_part.select("part", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc", "row", "bytes")
    blobs = packed.select("part", "kind", "blob", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("bytes"))
    return texts.unionByName(blobs).repartition(tasks, "part").sortWithinPartitions("part", "kind")


def as_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(named(text_col), F.lit(""))
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.cast("binary").alias("bytes"))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows = as_rows(df)
    spans, parts = removed_spans(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (doc, _, text), own in _with_texts(batches, SPAN):
            runs = united(own)
            sha, at = hashlib.sha256(), 0
            for lo, hi in runs:
                sha.update(text[at:lo])
                at = hi
            sha.update(text[at:])
            out.append((None if doc == LAST else doc, len(text), sum(hi - lo for lo, hi in runs), len(runs), sha.hexdigest()))
            if len(out) == 4096:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        names, cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=names)

    tasks = max(1, parts // 4)
    return with_texts(rows, spans, parts, tasks).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df with the removed bytes cut out of its texts; chars_col, if there, is counted anew. Every row stays."""
    rows = as_rows(df, text_col)
    spans, parts = removed_spans(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, row, text), own in _with_texts(batches, SPAN):
            if len(own):
                kept, at = [], 0
                for lo, hi in united(own):
                    kept.append(text[at:lo])
                    at = hi
                left = b"".join([*kept, text[at:]]).decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([row], pa.int64()), pa.array([left], pa.string())], names=["doc", "row", "left"])

    tasks = max(1, parts // 4)
    changed = with_texts(rows, spans, parts, tasks).mapInArrow(run, "doc long, row long, left string").dropDuplicates(["doc", "row"])
    p, text, doc = free_prefix(df.columns, "cut_"), named(text_col), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    changed = written(changed.select(*(F.col(c).alias(f"{p}{c}") for c in changed.columns)))
    left = F.col(f"{p}left")
    joined = df.join(changed, (doc == F.col(f"{p}doc")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(f"{p}row")), "left")
    out = {text_col: F.coalesce(left, text)}
    if chars_col in df.columns:
        out[chars_col] = F.when(left.isNotNull(), F.char_length(left).cast(df.schema[chars_col].dataType)).otherwise(named(chars_col))
    return joined.select(*((out[c].alias(c) if c in out else named(c)) for c in df.columns))
