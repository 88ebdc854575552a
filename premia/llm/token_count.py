"""Token counts by a finite-state transducer whose chunk state maps compose by a parallel prefix scan.

The transducer reads characters. Its state is a pair: where the pre-split stands (`Mode`: inside a run of letters,
digits or marks, in white space whose last character is still open, or in an apostrophe that may become a contraction)
and the state of the token table of `bpe.Automaton` for the unfinished word. Each transition carries the number of
tokens that it adds (below zero where a longer token takes the place of several), so a text's count is the sum along
its path and no ids are made.

A chunk of a text is a *state map*: entry state -> (exit state, tokens). Maps compose associatively, (g after f)(s) =
(g(f(s).state).state, the sum of both counts), so a text is cut into chunks of CHUNK characters, the maps are found in
parallel, also of one text's chunks in many tasks, and `scan` composes neighbours in rounds.

Domain of a map. Where a space between two other characters stands in the CONTEXT characters before a chunk, its entry
state is known from there on, whatever was before. Else the entries are the states that the context leads to from each
of its characters on (the phases that a text without spaces can have). A composed path that needs another entry asks
for it, and the chunk is run again from there: this repeats until every path is whole, so counts are exact always.

Inside a chunk, what lies between its first and its last such space does not depend on the entry; whole words there
are transitions that are looked up once they have been taken.

Defined results: null or empty text counts 0 bytes and 0 tokens; added special strings inside a text count as one
token each; repeated rows give repeated rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm._common import arrow_map, slices, written
from premia.llm.bpe import Automaton, load

CHUNK = 1 << 16
CONTEXT = 64
_RESET = re.compile(r"(?<=\S) (?=\S)")
# The contractions that the byte-level pre-split takes as words.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_OPENS = {c[:2] for c in CONTRACTIONS if len(c) == 3}

# (what the pre-split is in: "" between words, "L", "N", "P" runs, "W" open white space, "'" an apostrophe or an
# apostrophe and a letter that open a word; the open characters; the key of the table state of the unfinished word)
State = tuple[str, str, tuple]
Map = dict[State, tuple[State, int]]


class Transducer:
    """Runs states over characters. States are values, so that one worker's mean the same to another."""

    def __init__(self, a: Automaton):
        self.a, self.kinds = a, {}
        self.zero = a.keys[0]
        self.start: State = ("", "", self.zero)

    def kind(self, c: str) -> str:
        """Letter, digit, mark or white space: what the library's own pre-split leaves together with c."""
        k = self.kinds.get(c)
        if k is None:
            k = self.kinds[c] = next((k for k, probe in (("L", "a"), ("N", "1"), ("P", "!")) if len(self.a.split(probe + c)) == 1), "W")
        return k

    def feed(self, table: int, text: str) -> tuple[int, int]:
        """The table state after the bytes of text, and the tokens they add."""
        n, step, delta = 0, self.a.step, self.a.delta
        for b in text.encode("utf-8", "replace"):
            nxt = step[table].get(b)
            if nxt is None:
                nxt = self.a.make(table, b)
            table = nxt
            n += delta[table]
        return table, n

    def run(self, state: State, text: str) -> tuple[State, int]:
        mode, held, key = state
        self.a.trim()
        table, n = self.a.state_of(key), 0
        for c in text:
            k = self.kind(c)
            if mode == "'":  # held: an apostrophe, or that and the first of two letters
                word = held + c
                if word in CONTRACTIONS:
                    n += self.feed(0, word)[1]
                    mode, held, table = "", "", 0
                    continue
                if word in _OPENS:
                    held = word
                    continue
                table, m = self.feed(0, "'")
                n += m
                mode = "P"
                if len(held) == 2:
                    table, m = self.feed(0, held[1])
                    n += m
                    mode = "L"
                held = ""
            if mode == "W":
                if k == "W":  # the held character is not the last of the run
                    table, m = self.feed(table, held)
                    n += m
                    held = c
                    continue
                table, m = self.feed(0, held)  # what came before it was a word of its own, and is counted
                n += m
                if held != " ":
                    table = 0
                    mode = ""
                else:
                    mode = k  # the space goes with what follows
                held = ""
            if k == "W":
                mode, held, table = "W", c, 0
            elif mode != k and c == "'" and mode != "P":
                mode, held, table = "'", "'", 0
            else:
                if mode != k:
                    mode, table = k, 0
                table, m = self.feed(table, c)
                n += m
        return (mode, held, self.a.keys[table]), n

    def end(self, state: State) -> int:
        """The tokens that the end of the text adds: those of the open characters."""
        mode, held, key = state
        if mode == "'":
            return self.feed(0, "'")[1] + (self.feed(0, held[1])[1] if len(held) == 2 else 0)
        return self.feed(self.a.state_of(key), held)[1] if held else 0

    def parts(self, chunk: str) -> tuple[str, str, str]:
        """The chunk up to its first reset, between first and last, and from the last on."""
        first = _RESET.search(chunk)
        if first is None:
            return chunk, "", ""
        last = first.start()
        at = chunk.rfind(" ")
        while at > last:
            if at + 1 < len(chunk) and not chunk[at - 1].isspace() and not chunk[at + 1].isspace():
                last = at
                break
            at = chunk.rfind(" ", 0, at)
        return chunk[: first.start()], chunk[first.start() : last], chunk[last:]

    def chunk_map(self, chunk: str, entries: list[State]) -> Map:
        """The chunk's state map on the given entries."""
        head, mid, tail = self.parts(chunk)
        if not tail:
            return {s: self.run(s, head) for s in entries}
        out, n = self.run(self.start, tail)
        n += self.a.count_segment(mid)
        found = {}
        for s in entries:
            after, m = self.run(s, head)
            found[s] = out, m + self.end(after) + n
        return found

    def entries(self, before: str, whole: bool) -> list[State]:
        """The states in which a chunk may be entered; before: the characters before it, all of them if whole."""
        resets = [m.start() for m in _RESET.finditer(before)]
        if resets or whole:
            return [self.run(self.start, before[resets[-1] if resets else 0 :])[0]]
        return list(dict.fromkeys(self.run(self.start, before[i:])[0] for i in range(len(before))))


def compose(f: Map, g: Map) -> Map:
    """g after f, on those entries of f whose exit is an entry of g."""
    return {s: (g[t][0], n + g[t][1]) for s, (t, n) in f.items() if t in g}


def scan(maps: list[Map]) -> list[Map]:
    """All prefixes of a sequence of maps composed, by doubling: as many rounds as the length has binary digits."""
    out, step = list(maps), 1
    while step < len(out):
        out = [out[i] if i < step else compose(out[i - step], out[i]) for i in range(len(out))]
        step *= 2
    return out


def transducer(path: str) -> Transducer:
    a = load(path)
    if not hasattr(a, "transducer"):
        a.transducer = Transducer(a)
    return a.transducer


def cuts(t: Transducer, text: str, chunk: int) -> Iterator[tuple[str, str, bool]]:
    """(chunk, the characters before it, whether those are all of its segment); special strings give None."""
    for segment, special in t.a.segments(text):
        if special is not None:
            yield "", "", True
            continue
        for i in range(0, max(len(segment), 1), chunk):
            yield segment[i : i + chunk], segment[max(0, i - CONTEXT) : i], i <= CONTEXT


def count(a: Automaton, text: str | None, chunk: int = CHUNK) -> int:
    """The tokens of one text, its chunks composed here; entries that a path lacks are added."""
    t, n = a.transducer if hasattr(a, "transducer") else Transducer(a), 0
    for segment, special in a.segments(text or ""):
        if special is not None:
            n += 1
            continue
        pieces = [segment[i : i + chunk] for i in range(0, len(segment), chunk)]
        maps = [t.chunk_map(x, [t.start] if not i else t.entries(segment[max(0, i * chunk - CONTEXT) : i * chunk], i * chunk <= CONTEXT)) for i, x in enumerate(pieces)]
        while True:
            prefixes = scan(maps)
            broken = next((i for i, p in enumerate(prefixes) if t.start not in p), None)
            if broken is None:
                break
            entry = prefixes[broken - 1][t.start][0]
            maps[broken] |= t.chunk_map(pieces[broken], [entry])
        if maps:
            exit_, m = prefixes[-1][t.start]
            n += m + t.end(exit_)
    return n


# -- texts over many tasks -------------------------------------------------------------------------------------------
def _packed(found: Map) -> str:
    return json.dumps([[_plain(s), _plain(t), n] for s, (t, n) in found.items()], separators=(",", ":"))


def _plain(s: State) -> list:
    mode, held, (token, open_) = s
    return [mode, held, token, [[node, sorted(x) if isinstance(x, frozenset) else x, behind] for node, x, behind in open_]]


def _state(x: list) -> State:
    mode, held, token, open_ = x
    return mode, held, (token, tuple((node, frozenset(y) if isinstance(y, list) else y, behind) for node, y, behind in open_))


def _unpacked(raw: str) -> Map:
    return {_state(s): (_state(t), n) for s, t, n in json.loads(raw)}


def _kernel(names: list[str], types: list[pa.DataType], fn: Callable) -> Callable:
    """mapInArrow function from fn: row of Python values -> rows of Python values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in fn(*row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def long_counts(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """key, n_tokens of texts (key, text), each text's chunks counted in as many tasks as there are.

    Rows with equal keys must have equal texts. Chunks are dealt by (key, place); what is brought together for a
    text is its maps alone, one small row for each chunk.
    """

    def cut(key: str, text: str):
        t = transducer(path)
        for i, (piece, before, whole) in enumerate(cuts(t, text, chunk)):
            first = whole and not before
            yield key, i, piece, before, 1 if first and not piece else 2 if first else 3 if whole else 4

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    pieces = texts.mapInArrow(_kernel(["key", "i", "piece", "before", "kind"], kinds, cut), "key string, i long, piece string, before string, kind int")
    # kind 1: a special string; 2: a segment's first chunk; 3: entered from all that was before; 4: from a part of it
    pieces = written(pieces.dropDuplicates(["key", "i"]))
    tasks = max(1, -(-pieces.count() // 16))

    def map_of(key: str, i: int, piece: str, before: str, kind: int, asked: str | None = None):
        t = transducer(path)
        if kind == 1:
            yield key, i, kind, "[]"
        else:
            entries = [_state(json.loads(asked))] if asked else [t.start] if kind == 2 else t.entries(before, kind == 3)
            yield key, i, kind, _packed(t.chunk_map(piece, entries))

    of_map = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    found = written(pieces.repartition(tasks, "key", "i").mapInArrow(_kernel(["key", "i", "kind", "map"], of_map, map_of), "key string, i long, kind int, map string"))

    def whole(key: str, rows: list[dict]):
        t, n, segment = transducer(path), 0, []
        maps: dict[int, tuple[int, Map]] = {}
        for r in rows:
            kind, m = maps.setdefault(r["i"], (r["kind"], {}))
            m |= _unpacked(r["map"])
        order = sorted(maps)

        def close() -> tuple[int, State] | None:
            nonlocal n, segment
            if segment:
                prefixes = scan([maps[i][1] for i in segment])
                for k, p in enumerate(prefixes):
                    if t.start not in p:
                        return segment[k], prefixes[k - 1][t.start][0]
                exit_, m = prefixes[-1][t.start]
                n, segment = n + m + t.end(exit_), []
            return None

        for i in order:
            if maps[i][0] <= 2:
                if lacks := close():
                    break
                n += maps[i][0] == 1
            if maps[i][0] > 1:
                segment.append(i)
        else:
            lacks = close()
        yield key, None if lacks else n, lacks and lacks[0], lacks and json.dumps(_plain(lacks[1]))

    while True:
        rows = found.groupBy("key").agg(F.collect_list(F.struct("i", "kind", "map")).alias("rows"))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        done = written(rows.mapInArrow(_kernel(["key", "n_tokens", "i", "asked"], kinds, whole), "key string, n_tokens long, i long, asked string"))
        lacking = done.filter("n_tokens IS NULL").select("key", "i", "asked")
        if lacking.isEmpty():
            return done.select("key", "n_tokens")
        again = pieces.join(lacking, ["key", "i"]).select("key", "i", "piece", "before", "kind", "asked")
        found = found.unionByName(written(again.mapInArrow(_kernel(["key", "i", "kind", "map"], of_map, map_of), "key string, i long, kind int, map string")))


def token_counts(df: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Texts of one chunk are counted where they lie; the chunks of longer ones are dealt out.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = transducer(path)
        n = pa.array([count(t.a, x, chunk) for x in batch.column("text").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    far = F.length("text") > chunk
    short = arrow_map(rows.filter(~far), kernel, "doc_id long, n_bytes long, n_tokens long")
    long = rows.filter(far).withColumn("key", F.concat_ws(":", F.sha2("text", 256), F.col("n_bytes")))
    counted = long_counts(long.select("key", "text"), path, chunk)
    both = short.unionByName(long.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
