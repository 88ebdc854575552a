"""Connected components of a link table, by alternating large stars and small stars, all in Spark.

Each round is written to the shared folder, so a lost executor costs at most one round and the plan stays short. No
links or labels come to the driver, only whether any node is left that is not settled.
The least neighbours are summed up before the shuffle and written, so that the join that follows has two plain
shuffles as its sides: then the adaptive planner can split a centre that most links meet in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm._common import written


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links (u > v). Large star: neighbours above u go to the least of u's neighbourhood; small star: those below."""
    if small:
        near = links
        least = written(near.groupBy("u").agg(F.min("v").alias("m")))
        rest = near.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _settled(links: DataFrame) -> bool:
    """Are the links stars, every node above linked to one below that is not above itself? Then they are components."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    seen = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return seen.filter("above > 1 OR (above = 1 AND below = 1)").isEmpty()


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all links of a task."""
    ends = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*ends, strict=True) for x in pair]), return_inverse=True)
    u, v = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or not np.array_equal(label, before):
        before = label
        low = np.minimum(label[u], label[v])
        label = label.copy()
        for end in (u, v):
            np.minimum.at(label, before[end], low)
        while not np.array_equal(label, up := label[label]):
            label = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "label"])


def connected(links: DataFrame, a: str, b: str, at_once: int = 0) -> DataFrame:
    """node, label (the component's least node) for every node that occurs in a link between different nodes.

    at_once: up to so many links of whole numbers are connected in one task.
    """
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    if at_once and now.count() <= at_once:
        return now.coalesce(1).mapInArrow(together, "node long, label long")
    while not _settled(now):
        now = written(_star(_star(now, small=False), small=True))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
