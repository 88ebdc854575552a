"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source are shuffled by a hash. A copy of a document has a virtual finish time: the tokens (words) of
its source up to the middle of the copy, divided by the source's target; copy e comes after e whole rounds of the
source, at most `repeats` rounds. All copies of all sources are put in the order of their finish times, and the order
is cut where the words reach the total budget, the size of all documents. Merging the queues in this order takes from
each source in proportion to its target, and all sources reach their targets at time 1, where the budget is used up;
what a source has got then misses its target by about half a document.

Targets share the budget by weight; a target stops at `repeats` times its source's size and the excess is shared
again by weight. In the order of size over weight, the sources that stop are the first ones, so two running sums over
the sources give all targets.

No step needs a task that holds a source, all sources or all documents, and nothing of a size that grows with the
input comes to the driver. A source is cut into buckets by the first digits of the hash, the finish times into ranges;
sums of buckets and of ranges are added up in two levels, and only the one range in which the budget ends is ordered
copy by copy. The numbers of buckets and ranges grow with the rows.

Defined results: null or empty text has size 0 and nothing is taken; a source of size 0 has target 0; null is a
source of its own, the last; rows with equal doc_id are ordered by their text's hash, equal rows as they come (they
are interchangeable); an empty table gives an empty table; extra columns are ignored by `plan` and kept by `mix`,
whose own columns make way for columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.llm._common import discard, free_prefix, named, words, written
from premia.operators.charts import running

ROWS_A_BUCKET = 2000
SPAN = 1024  # buckets that are added up at once


def cycle_weights(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the rank (from 1) of a source in the order of code points, null last."""
    return ((rank - 1) % 3 + 1).cast("double")


def targets(per_source: DataFrame, weigh=cycle_weights, repeats: int = 3) -> DataFrame:
    """s, source_size, target of each source. per_source: s (null sources as the empty key), source_size."""
    ranked = running(per_source, [F.col("s") == "", F.col("s")], {"rank": F.lit(1)})
    weighed = ranked.select("s", "source_size", weigh(F.col("rank").cast("long")).alias("weight"))
    most = F.col("source_size").cast("double") * repeats
    rows = running(weighed.withColumns({"most": most, "ratio": most / F.col("weight")}), [F.col("ratio"), F.col("s")], {"stopped": F.col("most"), "heavy": F.col("weight"), "whole": F.col("source_size")})
    # what is left for this source and those after it, if all before it stop
    rate = (F.col("whole__all") - (F.col("stopped") - F.col("most"))) / (F.col("heavy__all") - F.col("heavy") + F.col("weight"))
    rows = written(rows.withColumn("stops", F.col("ratio") <= rate))
    left = rows.agg(F.max("whole__all").alias("a"), F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).alias("m"), F.sum(F.when(~F.col("stops"), F.col("weight"))).alias("w")).first()
    open_rate = (left["a"] - left["m"]) / left["w"] if left["w"] else 0.0
    return rows.select("s", "source_size", F.round(F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.lit(float(open_rate))), 6).alias("target"))


def before(sums: DataFrame, by: list[str], at: str, total: str) -> DataFrame:
    """sums with `before`, the total of the rows with a lesser `at` and equal `by`, added up in two levels."""
    sums = sums.withColumn("before_g", F.floor(F.col(at) / SPAN))
    coarse = sums.groupBy(*by, "before_g").agg(F.sum(total).alias("before_t"))
    up = (Window.partitionBy(*by) if by else Window).orderBy("before_g").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(*by, "before_g", F.coalesce(F.sum("before_t").over(up), F.lit(0)).alias("before_b"))
    inside = Window.partitionBy(*by, "before_g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    fine = sums.withColumn("before_i", F.coalesce(F.sum(total).over(inside), F.lit(0)))
    return fine.join(coarse, [*by, "before_g"]).withColumn("before", F.col("before_b") + F.col("before_i")).drop("before_b", "before_i", "before_g")


def plan(df: DataFrame, weigh=cycle_weights, repeats: int = 3, row: Column | None = None) -> DataFrame:
    """row, doc_id, source, text_hash, size, source_size, target, finish (of the first copy), copies, taken.

    weigh: the weight of a source as a column over its rank. row: a number that tells equal rows apart, if there is one.
    """
    source = F.col("source").cast("string")
    base = df.select(
        (row if row is not None else F.lit(0)).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("size")
    )
    base = written(base.withColumns({"key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "s": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}))
    per_source = written(base.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    found = per_source.agg(F.sum("n").alias("n"), F.sum("source_size").alias("size")).first()
    n, budget = found["n"] or 0, found["size"] or 0
    goals = targets(per_source.select("s", "source_size"), weigh, repeats)

    buckets = max(1, -(-n // ROWS_A_BUCKET))
    first = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    base = base.withColumn("bucket", F.floor(first * F.lit(buckets) / F.lit(1 << 28)).cast("long"))
    sums = before(base.groupBy("s", "bucket").agg(F.sum("size").alias("total")), ["s"], "bucket", "total").join(goals, "s").select("s", "bucket", "before", "source_size", "target")
    inside = Window.partitionBy("s", "bucket").orderBy("key", F.asc_nulls_first("doc_id"), "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("local", F.sum("size").over(inside)).join(sums, ["s", "bucket"])
    queued = written(rows.select("row", "doc_id", "source", "text_hash", "key", "size", "source_size", "target", (F.col("before") + F.col("local")).alias("at")))

    in_queue = (F.col("size") > 0) & (F.col("target") > 0)
    finish = lambda e: F.when(in_queue, (2 * (e * F.col("source_size") + F.col("at")) - F.col("size")) / (2 * F.col("target")))
    place = lambda t: F.least(F.floor(t * buckets), F.lit(2 * buckets)).cast("long")
    order = lambda e: F.struct(finish(e).alias("t"), F.col("key").alias("k"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_hash").alias("h"), F.col("row").alias("r"), e.cast("int").alias("e"))
    copies = queued.filter(in_queue).select("size", F.explode(F.array(*(order(F.lit(e)) for e in range(repeats)))).alias("o")).withColumn("range", place(F.col("o.t")))
    ends = before(copies.groupBy("range").agg(F.sum("size").alias("total")), [], "range", "total")
    over = ends.filter(F.col("before") + F.col("total") > budget).orderBy("range").first()  # the range in which the budget ends
    if over is None:
        taken = [in_queue for _ in range(repeats)]
    else:
        upto = F.lit(over["before"]) + F.sum("size").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0))  # one range of copies
        within = copies.filter(F.col("range") == over["range"]).withColumn("upto", upto).filter(2 * F.col("upto") - F.col("size") <= 2 * budget)
        last = within.agg(F.max("o").alias("o")).first()["o"]
        kinds = {"t": "double", "k": "string", "d": "long", "h": "long", "r": "long", "e": "int"}
        edge = F.struct(*(F.lit(last[k]).cast(kind).alias(k) for k, kind in kinds.items())) if last is not None else None
        at_edge = lambda e: order(e) <= edge if edge is not None else F.lit(False)
        taken = [F.coalesce((place(finish(F.lit(e))) < over["range"]) | ((place(finish(F.lit(e))) == over["range"]) & at_edge(F.lit(e))), F.lit(False)) for e in range(repeats)]
    number = F.lit(0).cast("long")
    for t in taken:
        number = number + F.when(t, 1).otherwise(0)
    done = queued.withColumns({"copies": number, "finish": finish(F.lit(0))})
    return done.select("row", "doc_id", "source", "text_hash", "size", "source_size", "target", "finish", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def in_order(planned: DataFrame) -> DataFrame:
    """A global range sort by virtual finish time."""
    return planned.repartitionByRange(F.asc_nulls_last("finish"), "doc_id").sortWithinPartitions(F.asc_nulls_last("finish"), "doc_id")


def mix(df: DataFrame, weigh=cycle_weights, repeats: int = 3) -> DataFrame:
    """The rows of df that the mix takes, each as often as it is taken, in the order of the queue, with df's columns."""
    p = free_prefix(df.columns, "mix_")
    # rows get a number for good, so that each finds its own decision however often it is repeated
    rows = written(df.withColumn(f"{p}row", F.monotonically_increasing_id()))
    decided = plan(rows, weigh, repeats, named(f"{p}row")).filter("copies > 0")
    decided = decided.select(F.col("row").alias(f"{p}row"), F.explode(F.transform(F.sequence(F.lit(0), F.col("copies").cast("int") - 1), lambda e: F.col("finish") + e * F.col("source_size") / F.col("target"))).alias(f"{p}time"))
    out = written(rows.join(decided, f"{p}row"))
    discard(rows)
    out = out.repartitionByRange(named(f"{p}time"), named(f"{p}row")).sortWithinPartitions(f"{p}time", f"{p}row")
    return out.select(*(named(c) for c in df.columns))
