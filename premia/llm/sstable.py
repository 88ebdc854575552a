"""Token-ID output as sorted-string-table shards.

A shard is one file, keys ascending:

    data blocks      entries (shared prefix, key rest, value), varint lengths; the first key of a block is whole
    index block      first key, offset and length of each data block
    Bloom filter     bits and number of probes
    footer           FOOTER: places of index and filter, documents, tokens, shard number, magic

Each of these rows ends with one byte 0x0A, which the offsets allow for, so that Spark's own writer, with its commit
protocol, lays the files into any Hadoop file system; a task that is run again replaces its file. A key is nine
bytes: 0 for a null document id, or 1 and the id as big-endian with its sign bit flipped, so that byte order is
numeric order. A value is one byte for the width (2 or 4) and the ids, little-endian.

Shards are cut by range of (doc_id, hash of the text), so that many rows with one id still spread over shards, and
the order of shards is the order of keys.

Defined results: null text is the empty text, which holds the end id alone; null ids sort before all others; rows
with equal ids are all kept, ordered by a hash of their text; an empty table writes no shard and reads back as no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premia.llm._common import ROWS, settings, slices
from premia.sources.scratch import PHASE

MAGIC = 0x5AB1E501
FOOTER = struct.Struct("<QQQQQQQQ")  # index place, length; filter place, length; documents, tokens, shard, magic
BLOCK = 1 << 16
BITS_PER_KEY, PROBES = 10, 7
MAX_WORDS = 800_000
# A text of ASCII and Latin-1 letters in which no two white spaces meet, and its words: byte-level pre-splitting finds the
# same in every Unicode version.
PLAIN = re.compile("(?:[ \n]?+[!-~À-ÖØ-öø-ÿ]++)*+\n?").fullmatch
PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\\[-`{-~]+|\n").findall
BYTES = {c: bytes([195, c - 64]).decode("latin-1").translate({x: x + 162 for x in range(127, 161)} | {173: 323}) for c in range(192, 256)}  # as byte-level tokenizers spell them
# A space next to other white space on both sides, where cutting could change the pre-split.
INNER = re.compile(r"\s \s|\s \Z").search
# Letters, then plain punctuation or nothing: two words or one in every Unicode version.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&*-/:-@]*)").fullmatch
# The same, and perhaps a line end, which is a word of its own before a letter, and such words again.
LINES = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&*-/:-@]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&*-/:-@]*))?").fullmatch


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1)


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Turns ascending (key, value) entries into the rows of one shard file."""

    def __init__(self, shard: int):
        self.shard, self.block, self.first, self.last = shard, bytearray(), b"", b""
        self.place, self.index, self.hashes, self.docs, self.tokens = 0, bytearray(), [], 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> Iterator[bytes]:
        value, shared = pack(ids), 0
        if self.block:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.docs, self.tokens = key, self.docs + 1, self.tokens + len(ids)
        self.hashes.append(key)
        if len(self.block) >= BLOCK:
            yield self._flush()

    def _flush(self) -> bytes:
        out = bytes(self.block)
        self.index += varint(len(self.first)) + self.first + varint(self.place) + varint(len(out))
        self.place += len(out) + 1
        self.block = bytearray()
        return out

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._flush()
        index = bytes(self.index)
        yield index
        bits = max(64, BITS_PER_KEY * self.docs)
        table = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for p in probes(key, bits):
                table[p >> 3] |= 1 << (p & 7)
        bloom = bits.to_bytes(8, "little") + bytes(table)
        yield bloom
        at = self.place + len(index) + 1
        yield FOOTER.pack(self.place, len(index), at, len(bloom), self.docs, self.tokens, self.shard, MAGIC)


class Shard:
    """Reads one shard from its bytes: `get` by filter, binary search and one block; `entries` in order."""

    def __init__(self, data: bytes):
        self.data = data
        self._head(data[len(data) - FOOTER.size - 1 :], lambda at, n: data[at : at + n])

    def _head(self, footer: bytes, read: Callable[[int, int], bytes]) -> None:
        index, n, bloom, m, self.docs, self.tokens, self.number, magic = FOOTER.unpack_from(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw = read(bloom, m)
        self.bits, self.bloom = int.from_bytes(raw[:8], "little"), raw[8:]
        self.firsts, self.blocks, raw, at = [], [], read(index, n), 0
        while at < n:
            k, at = read_varint(raw, at)
            self.firsts.append(raw[at : at + k])
            place, at = read_varint(raw, at + k)
            size, at = read_varint(raw, at)
            self.blocks.append((place, size))

    def _bytes(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        raw, at, key = self._bytes(*self.blocks[i]), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays stored under a document id (several if the id was repeated)."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        out = []
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:  # a repeated key may fill several blocks
            i -= 1
        for i in range(i, len(self.blocks)):
            if self.firsts[i] > key:
                break
            out += [unpack(v) for k, v in self._block(i) if k == key]
        return out


class LibraryEncoder:
    """The tokenizers library, asked once for each word that comes again.

    A plain text is cut into its words, which are looked up; those not seen before go to the library's model, many to a
    call. Other texts are cut at spaces between other characters, where byte-level pre-splitting always cuts; the library encodes
    the pieces not seen before, in one batch, and their packed ids are joined. Texts with added special strings or
    with spaces inside longer white space go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.line = self.lib.encode("\n", add_special_tokens=False).ids
        self.cuts = self.cuts and len(self.line) == 1
        self.cache: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # words of plain texts: those of late, and those before that
        self.older: dict[str, bytes] = {}
        self.words = Tokenizer(self.lib.model)  # the same model, for words that are cut and spelt in bytes already
        self.words.pre_tokenizer = CharDelimiterSplit(" ")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str], space: str, into: dict[str, bytes]) -> None:
        """Encode plain words, many to a call: a line end between two of them is a word, and a token, of its own."""
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.lib.encode_batch_fast([space + f"\n{space}".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = [0, *(np.flatnonzero(ids == self.line) + 1).tolist(), len(ids) + 1]
            if len(cuts) != len(some) + 1:
                raise AssertionError("a word was not encoded by itself")
            raw, width = ids.tobytes(), self.dtype.itemsize
            into.update((x, raw[a * width : (b - 1) * width]) for x, a, b in zip(some, cuts, cuts[1:], strict=False))

    def _learn_pieces(self, missing: set[str]) -> None:
        """Put the ids of words into pieces; short lists of them are fastest in the library."""
        known, older, width = self.pieces, self.older, self.dtype.itemsize
        known["\n"] = np.array(self.line, self.dtype).tobytes()
        known.update((x, older[x]) for x in missing if x in older)
        new = sorted((x for x in missing if x not in known), key=str.isascii)  # few lists have to be spelt in bytes
        for i in range(0, len(new), 200):
            some = new[i : i + 200]
            spelt = "\n".join(some)
            if not spelt.isascii():
                spelt = spelt.translate(BYTES)
            ids = np.array(self.words.encode_batch_fast([spelt.replace(" ", "Ġ").replace("\n", " Ċ ")], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(ids == self.line) * width).tolist()
            if len(ends) != len(some) - 1:
                raise AssertionError("a word was not encoded by itself")
            raw = ids.tobytes()
            known.update(zip(some, map(raw.__getitem__, map(slice, [0, *(x + width for x in ends)], [*ends, len(raw)])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed little-endian in self.dtype."""
        out: list[bytes] = [b""] * len(texts)
        plain, other, missing = [], [], set()
        if len(self.pieces) > MAX_WORDS // 2:
            self.older, self.pieces = self.pieces, {}
        for i, text in enumerate(texts):
            if self.cuts and PLAIN(text) and not any(x in text for x in self.special):
                packed = list(map(self.pieces.get, words := PIECES(text)))
                new = {k: words[k] for k, ids in enumerate(packed) if ids is None}
                missing.update(new.values())
                plain.append((i, packed, new))
            else:
                other.append(i)
        if missing:
            self._learn_pieces(missing)
        for i, packed, new in plain:
            for k, x in new.items():
                packed[k] = self.pieces[x]
            out[i] = b"".join(packed)
        for x in [x for x in missing if len(x) > 64]:
            del self.pieces[x]
        for i, ids in zip(other, self._encode_other([texts[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _encode_other(self, texts: list[str]) -> list[bytes]:
        cache, found, whole, missing = self.cache, [], [], set()
        if len(cache) > MAX_WORDS // 4:
            cache.clear()
        for i, text in enumerate(texts):
            if not self.cuts or INNER(text) or any(x in text for x in self.special):
                whole.append(i)
                found.append(None)
            else:
                first, *parts = text.split(" ")  # the cache holds a piece without the space before it
                packed = list(map(cache.get, parts))
                found.append((first, parts, packed))
                if None in packed:
                    missing.update(x for x, ids in zip(parts, packed, strict=True) if ids is None)
        firsts = [f[0] for f in found if f]
        self._learn(missing, firsts)
        firsts = [self.start(x) for x in firsts][::-1]
        out = []
        for f in found:
            if f is None:
                out.append(b"")
                continue
            _, parts, packed = f
            if None in packed:
                packed = [cache[x] if ids is None else ids for x, ids in zip(parts, packed, strict=True)]
            out.append(firsts.pop() + b"".join(packed))
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        for x in [x for x in missing if len(x) > 64]:
            del cache[x]
        return out

    def start(self, piece: str) -> bytes:
        """The ids of a piece without a space before it, whose words are known if it is plain."""
        if (m := SIMPLE(piece)) is None:
            return self._library([piece])[0] if piece else b""
        return self.bare[m[1]] + (self.marks[m[2]] if m[2] else b"")

    def _learn(self, missing: set[str], firsts: list[str]) -> None:
        """Put the ids of pieces into the cache (each with a space before it), and the words of firsts into bare."""
        cache, bare, marks = self.cache, self.bare, self.marks
        plain, first_words, made, other = set(), set(), [], []
        if len(bare) > MAX_WORDS // 4:
            bare.clear()
        if len(marks) > MAX_WORDS // 4:
            marks.clear()
        for x in firsts:
            if m := SIMPLE(x):
                first_words.add(m[1])
                if m[2] and m[2] not in marks:
                    marks[m[2]] = self._library([m[2]])[0]
        for x in missing:
            if (m := LINES(x)) is None:
                other.append(x)
                continue
            word, mark, word2, mark2 = m.groups()
            if word not in cache:
                plain.add(word)
            for y in (mark, mark2):
                if y and y not in marks:
                    marks[y] = self._library([y])[0]
            if word2:
                first_words.add(word2)
            if mark or word2:
                made.append((x, word, mark, word2, mark2))
        if other:
            cache.update(zip(other, self._library([" " + x for x in other]), strict=True))
        self._lines(list(plain), " ", cache)
        self._lines([w for w in first_words if w not in bare], "", bare)
        line = np.array(self.line, self.dtype).tobytes()
        for x, word, mark, word2, mark2 in made:
            ids = cache[word] + marks[mark] if mark else cache[word]
            if word2:
                ids += line + bare[word2] + (marks[mark2] if mark2 else b"")
            cache[x] = ids


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 16 << 20) -> None:
    """Encode doc_id, text with the tokenizers library, append end_id, write shards of about shard_bytes of text."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, -(-size // shard_bytes)), F.asc_nulls_first("doc_id"), "h")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out = library_encoder(tokenizer), Writer(TaskContext.get().partitionId())
        for batch in slices(batches, 32):
            made = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), t.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                made += out.add(key_of(doc_id), np.append(np.frombuffer(packed, t.dtype), np.array(end_id, t.dtype)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
        if out.docs:
            yield pa.RecordBatch.from_arrays([pa.array(list(out.finish()), pa.binary())], names=["value"])

    # a cast from binary to string keeps the bytes as they are, and the text writer writes them as they are
    with settings(df.sparkSession, PHASE | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}):
        rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, place (in the shard), doc_id, n_tokens, local_start, ids_crc32 of each document, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if not len(data := data.as_py()):
                    continue
                s, rows, start = Shard(data), [], 0
                for place, (key, value) in enumerate(s.entries()):
                    ids = unpack(value)
                    rows.append((s.number, place, id_of(key), len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                names = ["shard", "place", "doc_id", "n_tokens", "local_start", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "shard long, place long, doc_id long, n_tokens long, local_start long, ids_crc32 long")


class Table:
    """Point reads from the shards of a folder in any Hadoop file system; only the bytes that are needed are read.

    The shards are in key order, so a key's shards are found by binary search over their first keys. Of a shard the
    footer, the index and the filter are read once, and then a block for each key that the filter lets pass.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.read_all = jvm.org.apache.commons.io.IOUtils.toByteArray
        found = [s for s in self.fs.listStatus(folder) if s.isFile() and s.getLen() > 0 and s.getPath().getName().startswith("part-")]
        self.files = sorted(((s.getPath().getName(), s.getPath(), s.getLen()) for s in found), key=lambda f: f[0])
        self.heads: dict[int, RangedShard] = {}
        self.bytes_read = 0

    def read(self, i: int, at: int, n: int) -> bytes:
        stream = self.fs.open(self.files[i][1])
        try:
            stream.seek(at)
            self.bytes_read += n
            return bytes(self.read_all(stream, n))
        finally:
            stream.close()

    def shard(self, i: int) -> RangedShard:
        if i not in self.heads:
            self.heads[i] = RangedShard(lambda at, n: self.read(i, at, n), self.files[i][2])
        return self.heads[i]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays stored under a document id, in the order of the files."""
        key, lo, hi = key_of(doc_id), 0, len(self.files)
        while lo < hi:  # the first shard that begins at the key or after it
            mid = (lo + hi) // 2
            if self.shard(mid).firsts[0] < key:
                lo = mid + 1
            else:
                hi = mid
        out = []
        for i in range(max(0, lo - 1), len(self.files)):
            if self.shard(i).firsts[0] > key:
                break
            out += self.shard(i).get(doc_id)
        return out


class RangedShard(Shard):
    """A shard that is read piece by piece."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        self._head(read(size - FOOTER.size - 1, FOOTER.size), read)

    def _bytes(self, at: int, n: int) -> bytes:
        return self.read(at, n)


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of the asked documents. For more ids than a driver should ask for, join `read_shards`."""
    table = Table(spark, path)
    return spark.createDataFrame([(i, x.tolist()) for i in doc_ids for x in table.get(i)], "doc_id long, ids array<long>")


def with_starts(docs: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before. The running sum is over shards (one row each), not documents."""
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))
    return docs.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("local_start"))
