"""Document fingerprints: SpotSigs, in DataFrame functions only.

A spot is a common word (an *anchor*) with the chain of the content words that follow it, common words left out.
Common are the ANCHORS words that the most documents have, counted over all of them. The fingerprint of a text is the
set of its spots, each hashed to 32 bits, written in ascending order. The likeness of two fingerprints is the Jaccard
similarity of the sets.

`near_classes` connects all texts with a likeness of at least tau. Equal fingerprints are one class. Classes are
partitioned by set length, so that only a partition and the next can reach tau; of a set, only the first
n - ceil(tau n) + 1 spots, the rarest first, are looked up, one of which two like sets must share. At the first spot
that they share, both must have enough spots left for the overlap that their lengths ask for; so the shorter one is
looked up by fewer still, and short texts that quote one passage do not meet in its spots. Parities of the sets prune
once more, and what is left is compared exactly. Only ids, lengths and spots travel until then. Rare is what falls into
a light one of BUCKETS counters of all spots; any order that is the same everywhere will do, and this one puts the
spots of a line that many texts share last. Sets with one spot are first joined to one of them, which settles groups of
copies, then (TURNS times) to one drawn anew for each spot, which settles near copies that are not like the first, and
then all with all between classes that are still different, crowded spots in parts of BLOCK.

Defined results: null is the empty text; a text without any spot has one spot, the hash of the text, and the empty
text has none; two empty fingerprints have likeness 1, an empty and another 0; equal texts have equal fingerprints;
rows with equal doc_id are ordered by their text's hash, null doc_ids come last; the class is the least doc_id in it,
null if there is none; an empty table gives an empty table, and in a table of one row the next document is the row
itself; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.llm._common import bind, discard, settings, written
from premia.llm.components import connected
from premia.sources.scratch import PHASE

ANCHORS = 200
CHAIN = 2
CELLS = 4096
BUCKETS = 1 << 14
BLOCK = 4096
SPAN = 1024
TURNS = 1


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def common_words(df: DataFrame, text_col: str = "text", most: int = ANCHORS) -> list[str]:
    """The words that the most documents have, ties in the order of the words."""
    rows = df.select(F.explode(F.array_distinct(words(F.col(f"`{text_col}`")))).alias("w")).groupBy("w").count()
    with settings(df.sparkSession, PHASE):
        return [r["w"] for r in rows.orderBy(F.desc("count"), "w").limit(most).collect()]


def spots(text: Column, common: list[str]) -> Column:
    """The sorted set of a text's spots, array<int>."""
    text = F.coalesce(text, F.lit(""))

    def of_words(a: Column) -> Column:
        places = F.filter(F.transform(a, lambda x, i: F.when(x.isin(common), i)), lambda i: i.isNotNull())
        content = F.filter(a, lambda x: ~x.isin(common))
        # before the k-th anchor, at place i, there are i - k content words
        return bind(content, lambda c: F.transform(places, lambda i, k: F.hash(F.get(a, i), *(F.get(c, i - k + j) for j in range(CHAIN)))))

    found = bind(words(text), of_words) if common else F.array().cast("array<int>")
    return bind(found, lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).when(text == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text))))


def written_out(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: x.cast("string")), ",")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return bind(both, lambda n: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def with_next(df: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in descending doc_id, of the first row after the last.

    Ids are cut into equal cells (at most CELLS, one small row each), crowded cells into more parts by id, and where a
    part is one id already, by hash, as are the null ids; so a bucket holds about bucket_bytes of text. Each bucket
    also gets the first row of the bucket below.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, n, lo, hi = rows.agg(F.sum(F.octet_length("text")), F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (lo or 0), (hi or 0)
    width = (hi - lo) // CELLS + 1
    cell = F.floor((F.col("doc_id") - lo) / F.lit(width)).cast("int") if hi - lo < 1 << 52 else F.expr(f"int((cast(doc_id as decimal(38,0)) - {lo}) div {width})")
    rows = rows.withColumn("cell", F.coalesce(cell, F.lit(-1))).withColumn("h", F.xxhash64("text"))
    per = max(1, int((n or 1) * bucket_bytes / max(size or 1, 1)))
    table, at = [], 0
    fill = 0
    for c, m in sorted((r["cell"], r["count"]) for r in rows.groupBy("cell").count().collect()):
        parts = -(-m // per)
        by_id = 1 if c < 0 else min(parts, width)
        by_hash = max(1, -(-parts // by_id)) if by_id == width or c < 0 else 1
        if c < 0 or parts > 1 or fill + m > per:
            at, fill = at + 1, 0
        table.append((c, at, by_id, by_hash))
        at, fill = (at + by_id * by_hash, 0) if c < 0 or parts > 1 else (at, fill + m)
    of_cell = {c: each for c, *each in table}  # CELLS + 2 at most, as constants by the cell's number
    for i, name in enumerate(("first", "by_id", "by_hash")):
        values = ",".join(str(of_cell.get(c, (0, 1, 1))[i]) for c in range(-1, CELLS + 1))
        rows = rows.withColumn(name, F.get(F.split(F.lit(values), ",").cast("array<bigint>"), F.col("cell") + 1))
    inside = F.coalesce(F.floor((F.col("doc_id") - lo - F.col("cell").cast("long") * width) * F.col("by_id") / F.lit(width)).cast("long"), F.lit(0))
    # within one id, lesser hashes come first, that is in the upper buckets
    upper = F.col("by_hash") - 1 - F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * F.col("by_hash") / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("bucket", F.col("first") + inside * F.col("by_hash") + upper).select("doc_id", "text", "h", "bucket")
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("d"), F.col("doc_id").isNotNull().alias("n"), (-F.col("h")).alias("h"))
    heads = written(rows.groupBy("bucket").agg(F.max(key).alias("top")))
    # a bucket's first row also closes the bucket above, the very first the lowest; found in two levels
    heads = heads.withColumn("g", F.floor(F.col("bucket") / SPAN))
    groups = heads.groupBy("g").agg(F.min("bucket").alias("least"))
    above = groups.select("g", F.lead("least").over(Window.orderBy("g")).alias("after"), F.min("least").over(Window.partitionBy()).alias("lowest"))
    up = F.lead("bucket").over(Window.partitionBy("g").orderBy("bucket"))
    # written, so that the planner knows its size: small ones are broadcast, large ones are not
    closes = written(heads.withColumn("up", up).join(above, "g").select(F.col("bucket").alias("b"), "top", F.coalesce("up", "after", "lowest").alias("closes")))
    closing = rows.withColumn("key", key).join(closes, (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("top"))).dropDuplicates(["closes"])
    both = rows.withColumn("extra", F.lit(0)).unionByName(closing.select("doc_id", "text", "h", F.col("closes").alias("bucket"), F.lit(1).alias("extra")))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "h")
    return both.withColumn("next_text", F.lead("text").over(order)).filter("extra = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(df: DataFrame, tau: float = 0.8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_class of each text.

    near_class: the least doc_id that can be reached through texts with a likeness of at least tau.
    """
    common = common_words(df)
    n = F.char_length("text")
    rows = with_next(df).withColumn("n_chars", n.cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), spots(F.col("text"), common).alias("own"), spots(F.col("edited"), common).alias("of_edited"), spots(F.col("next_text"), common).alias("of_next"))
    # sets and hash stay in binary until the end: the rows are dealt by their class once more
    rows = written(rows.select("doc_id", "n_chars", "sha", "own", "of_edited", likeness(F.col("own"), F.col("of_edited")).alias("near_edited"), likeness(F.col("own"), F.col("of_next")).alias("near_next"), F.xxhash64("own").alias("node")))
    classes = near_classes(rows.select("doc_id", F.col("own").alias("s"), "node"), tau)
    out = rows.join(classes, "node")
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), written_out(F.col("own")).alias("fingerprint"), written_out(F.col("of_edited")).alias("edited_fingerprint"), "near_edited", "near_next", "near_class")


def near_classes(sets: DataFrame, tau: float = 0.8) -> DataFrame:
    """node, near_class over doc_id, s (the sorted spots), node (their hash)."""
    classes = written(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("s").alias("s")))
    found = None
    for part in like_pairs(classes.select("node", "s"), tau):
        found = part
    label = written(classes.select("node", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
    discard(classes)
    ids = written(label.groupBy("label").agg(F.min("least").alias("near_class")))
    return label.join(ids, "label").select("node", "near_class")


def light(classes: DataFrame) -> Column:
    """spot -> how many sets have a spot in its counter, as an expression over the lambda variable given to it."""
    counts = {r["b"]: r["n"] for r in classes.select(F.explode("s").alias("x")).groupBy(F.pmod("x", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n")).collect()}
    table = F.split(F.lit(",".join(str(min(counts.get(b, 0), (1 << 31) - 1)) for b in range(BUCKETS))), ",").cast("array<int>")
    return lambda x: F.get(table, F.pmod(x, F.lit(BUCKETS)))


def placed(classes: DataFrame, tau: float) -> DataFrame:
    """p, spot, own, short, node, n, left: the sets looked up in each partition by each of their rarest spots.

    left: how many spots of a set are there from this one on. Like sets share at least tau / (1 + tau) of the sum of
    their lengths, counted from the first spot they share: so the shorter of two finds it while a share of
    2 tau / (1 + tau) is left (short), the longer while tau is. A set that may be the shorter in partition p also
    visits p + 1 (own = false).
    """
    weight = light(classes)
    n = F.size("s")
    ranked = F.array_sort(F.transform("s", lambda x: F.struct(weight(x).alias("w"), x.alias("x"))))
    first = F.slice(ranked, 1, n - F.ceil(n * F.lit(tau) - 1e-9).cast("int") + 1)
    p = F.floor(F.log(n) / F.lit(-math.log(tau)) + 1e-9).cast("int")
    rows = classes.filter(n > 0).select("node", n.alias("n"), p.alias("p"), F.posexplode(first).alias("i", "f")).select("node", "n", "p", F.col("f.x").alias("spot"), (F.col("n") - F.col("i")).alias("left"))
    rows = rows.withColumn("short", F.col("left") >= F.lit(2 * tau / (1 + tau)) * F.col("n") - 1e-9)
    visits = F.when(F.col("short"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("v", F.explode(visits)).select((F.col("p") + F.col("v")).alias("p"), "spot", (F.col("v") == 0).alias("own"), "short", "node", "n", "left")


def parities(s: Column) -> Column:
    """256 bits, four longs: the parity of the spots in each of 256 classes. Two sets differ in as many spots at least as in bits."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    part = lambda k: F.filter(s, lambda x: F.floor(F.pmod(x, F.lit(256)) / 64) == k)
    return F.array(*(F.aggregate(part(k), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x))) for k in range(4)))


def verified(pairs: DataFrame, classes: DataFrame, tau: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a likeness of tau or more, each once."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = one.join(classes.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(classes.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return both.filter(likeness(F.col("sa"), F.col("sb")) >= tau).select("a", "b")


def like_pairs(classes: DataFrame, tau: float):
    """node, label tables, one after each turn: the last one connects all sets (node, s) with a likeness of tau or more."""
    placings = written(placed(classes, tau))
    at = ["p", "spot"]
    star = F.min(F.when(F.col("short"), F.struct("node", "n", "left")))
    crowded = written(placings.groupBy(*at).agg(star.alias("star"), F.max("own").alias("any"), F.count("*").alias("m")).filter("m > 1 AND any AND star IS NOT NULL").drop("any"))
    cells = written(placings.join(crowded, at))
    discard(placings)

    def fits(a: str, b: str) -> Column:
        """Can the sets be alike if this spot is the first they share?"""
        return F.least(F.col(f"{a}.left"), F.col(f"{b}.left")) >= F.lit(tau / (1 + tau)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-9

    def open_still(a: str, b: str) -> Column:
        """Of different classes so far, fitting, and not apart by their parities alone."""
        differ = sum(F.bit_count(F.get(f"{a}.bits", k).bitwiseXOR(F.get(f"{b}.bits", k))) for k in range(4))
        few = differ <= F.lit((1 - tau) / (1 + tau)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-9
        return (F.col(f"{a}.label") != F.col(f"{b}.label")) & fits(a, b) & few

    def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows with their labels, of cells with more than one; m: how many a cell has. The table rows goes."""
        now = written(rows.join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
        mixed = written(now.groupBy(*at).agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m")).filter("l0 != l1").select(*at, "m"))
        out = written(now.join(mixed, at))
        for each in (rows, now, mixed):
            discard(each)
        return out

    def linked(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return written(connected(verified(pairs, classes, tau).unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b"))), "a", "b"))

    rays = cells.alias("a").filter((F.col("a.node") != F.col("star.node")) & fits("a", "star")).select(F.col("a.node").alias("a"), F.col("star.node").alias("b"))
    found = written(connected(verified(rays, classes, tau), "a", "b"))
    yield found
    sides = [*at, "own", "short", "node", "n", "left"]
    rows = written(cells.select(*sides).join(classes.select("node", parities(F.col("s")).alias("bits")), "node"))
    discard(cells)
    discard(crowded)
    rows = apart(rows, found)
    for turn in range(TURNS):
        star = F.min(F.when(F.col("short"), F.struct(F.xxhash64("node", "spot", F.lit(turn)).alias("h"), "node", "n", "left", "bits", "label")))
        stars = written(rows.groupBy(*at).agg(star.alias("star")).filter("star IS NOT NULL"))
        rays = rows.join(stars, at).alias("a").filter(open_still("a", "star")).select(F.col("a.node").alias("a"), F.col("star.node").alias("b"))
        found = linked(rays, found)
        yield found
        discard(stars)
        rows = apart(rows.drop("label", "m"), found)
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    a = rows.filter("short").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("a")
    b = rows.filter("own").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("b")
    in_order = F.struct("a.n", "a.node") < F.struct("b.n", "b.node")
    on = (F.col("a.p") == F.col("b.p")) & (F.col("a.spot") == F.col("b.spot")) & (F.col("a.part") == F.col("b.part")) & in_order & open_still("a", "b")
    found = linked(a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), found)
    discard(rows)
    yield found
