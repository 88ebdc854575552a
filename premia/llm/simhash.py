"""SimHash near-duplicates by segment popcounts.

Fingerprint: words of the lower-cased (A-Z) text, 4-word shingles with repeats, XXH64 (seed 42) of each; a bit is 1
if it is set in over half of the hashes.

Links: fingerprints at `DISTANCE` or fewer differing bits. A fingerprint is embedded as the vector of the bit counts
of its 2-bit segments; the Manhattan distance of two such vectors is at most the Hamming distance of the fingerprints.
The vector's coordinates form g groups; if the Manhattan distance is at most d, at least g - d groups are equal. So
each fingerprint is put into one grid cell for each choice of g - d groups, and linked fingerprints share a cell. Of
the pairs of a cell only those within the Manhattan distance go on, a lower bound, and these are verified exactly. g
grows with the number of fingerprints, to keep cells small; a cell of more than `BLOCK` is joined in parts.

Groups of copies: equal fingerprints are one class. Dense groups of near copies would make a square number of pairs,
so cells are first joined by stars (each member against one member of its cell, another one each round), and pairs
are only tried between classes that are not connected already. What is connected is settled; no link between
unconnected classes is skipped.

Defined results: null or empty text, or one without words, has fingerprint zero, linked like any other; null doc_ids
are linked too but are not a component's id unless it has no other; repeated rows are kept; an empty table gives an
empty table; extra columns are ignored by `components` and kept by `deduplicate`, whose own columns make way for
columns of the same name. A row is known by its doc_id (null apart from any number) and its text's 64-bit hash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.llm._common import arrow_map, free_prefix, named, written
from premia.llm.components import connected

DISTANCE, SHINGLE, SEED = 4, 4, 42
BLOCK = 4096  # fingerprints of a cell that one side of a join holds
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts."""
    hashes, sizes, h64 = [], [], xxhash.xxh64_intdigest
    for text in texts:
        joined = b" ".join((text or "").encode("utf-8", "replace").translate(_UPPER_TO_LOWER).split())
        if not joined:
            sizes.append(0)
            continue
        cuts = [-1, *np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist(), len(joined)]
        if len(cuts) <= SHINGLE + 1:
            own = [h64(joined, SEED)]
        else:
            own = [h64(joined[a + 1 : b], SEED) for a, b in zip(cuts, cuts[SHINGLE:], strict=False)]
        hashes += own
        sizes.append(len(own))
    out, n = np.zeros(len(texts), np.uint64), np.array(sizes, np.int64)
    if not hashes:
        return out
    h, some = np.array(hashes, np.uint64), n > 0
    starts = (np.cumsum(n) - n)[some]
    for byte in range(8):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, byte : byte + 1], axis=1, bitorder="little")
        over = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > n[some, None]
        out[some] |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's 64 bits as a signed long)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.concatenate([fingerprint(batch.column(2)[i : i + 64].to_pylist()) for i in range(0, batch.num_rows, 64)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "text_hash", "fp"])

    text = named(text_col)
    return arrow_map(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), kernel, "doc_id long, text_hash long, fp long")


def grid(n: int) -> int:
    """Groups of segments, such that a fingerprint meets about 200 candidates by chance at most."""
    for g in (6, 7, 8, 10, 12):
        tables = len(list(combinations(range(g), g - DISTANCE)))
        if n * tables / 2 ** (45.2 * (g - DISTANCE) / g) <= 200:
            return g
    return 12


def _masks(g: int) -> list[int]:
    """A mask over the packed popcounts for each choice of g - DISTANCE groups of the 32 segments."""
    cuts = [64 * i // g // 2 * 2 for i in range(g + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(own[i] for i in c) for c in combinations(range(g), g - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(classes: DataFrame, n: int) -> DataFrame:
    """t, key, fp: the grid cells of each fingerprint. Two bits of the key hold a segment's popcount."""
    masks = [F.struct(F.lit(t).alias("t"), F.col("packed").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(_masks(grid(n)))]
    return classes.select("fp", packed_counts(F.col("fp")).alias("packed")).select("fp", F.explode(F.array(*masks)).alias("c")).select("c.t", "c.key", "fp")


def packed_counts(fp: Column) -> Column:
    """The 32 segment popcounts, two bits each: low bit = a bit is set, high bit = both are."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two vectors of popcounts: each count is written as so many ones."""
    return F.bit_count(packed_counts(a).bitwiseXOR(packed_counts(b)))


def linked(a: Column, b: Column) -> Column:
    """Within the lower bound, then within the distance itself."""
    return (manhattan(a, b) <= DISTANCE) & (distance(a, b) <= DISTANCE)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def labels(classes: DataFrame) -> DataFrame:
    """fp, label of all fingerprints that have a link (classes: distinct fp)."""
    spark = classes.sparkSession
    placed = written(cells(classes, classes.count()))
    found = spark.createDataFrame([], "node long, label long")
    for pick in (F.min, F.max):
        now = placed.join(found, placed["fp"] == found["node"], "left").select("t", "key", "fp", F.coalesce("label", "fp").alias("label"))
        least = now.groupBy("t", "key").agg(pick("fp").alias("star"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("t", "key", "star")
        rays = now.join(least, ["t", "key"]).filter((F.col("fp") != F.col("star")) & linked(F.col("fp"), F.col("star"))).select("fp", "star").distinct()
        known = found.select(F.col("node").alias("fp"), F.col("label").alias("star"))
        found = written(connected(rays.unionByName(known), "fp", "star"))
    now = written(placed.join(found, placed["fp"] == found["node"], "left").select("t", "key", "fp", F.coalesce("label", "fp").alias("label")))
    mixed = written(now.groupBy("t", "key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n")).filter("l0 != l1").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    now = written(now.join(mixed, ["t", "key"]))  # cells with two classes
    a = now.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).alias("a")
    b = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "key", "part")]
    on = same[0] & same[1] & same[2] & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.label") != F.col("b.label")) & linked(F.col("a.fp"), F.col("b.fp"))
    across = a.join(b, on).select(F.col("a.label").alias("fp"), F.col("b.label").alias("star")).distinct()
    known = found.select(F.col("node").alias("fp"), F.col("label").alias("star"))
    return connected(across.unionByName(known), "fp", "star").select(F.col("node").alias("fp"), "label")


def _grouped(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp of each row; fp, label, component_id, first of each fingerprint).

    first: is the doc_id null, the doc_id and the text hash of the component's first row.
    """
    base = written(fingerprints(df, text_col))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_hash").alias("h")))
    classes = written(base.groupBy("fp").agg(F.min("doc_id").alias("least"), least.alias("first")))
    grouped = written(labels(classes.select("fp")))
    of_class = written(classes.join(grouped, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    ids = written(of_class.groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("of_all")))
    return base, of_class.select("fp", "label").join(ids, "label").select("fp", "label", "component_id", F.col("of_all").alias("first"))


def components(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of each row (component_id: the smallest doc_id reachable)."""
    base, classes = _grouped(df, text_col)
    return base.join(classes.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_column(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df without near duplicates: of each component its first row, the one with the least doc_id.

    Of rows with one doc_id in a component the one with the least text hash stays, of equal rows one.
    """
    _, classes = _grouped(df, text_col)
    p, text, doc = free_prefix(df.columns, "dedup_"), named(text_col), F.col("doc_id").cast("long")
    keep = classes.select(*(F.col(f"first.{c}").alias(f"{p}{c}") for c in "ndh")).distinct()
    left = df.withColumns({f"{p}row_n": doc.isNull(), f"{p}row_d": F.coalesce(doc, F.lit(0)), f"{p}row_h": F.xxhash64(text)})
    rows = left.join(keep, (F.col(f"{p}row_n") == F.col(f"{p}n")) & (F.col(f"{p}row_d") == F.col(f"{p}d")) & (F.col(f"{p}row_h") == F.col(f"{p}h")))
    one = Window.partitionBy(f"{p}n", f"{p}d", f"{p}h").orderBy(F.length(text))
    return rows.withColumn(f"{p}i", F.row_number().over(one)).filter(F.col(f"{p}i") == 1).select(*(named(c) for c in df.columns))
