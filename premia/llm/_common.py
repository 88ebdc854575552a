"""Shared helpers: whole tables, scratch tables in the shared folder, word rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.sources import scratch as _scratch
from premia.sources.scratch import discard, scratch, settings, shared_dir

# The word separators of the contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[ \t\n\x0B\f\r]+"
# Rows of an Arrow batch in the phases that end in a table: long texts make default batches large.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write df into the shared folder, in small Arrow batches, and read it back."""
    with settings(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}):
        return _scratch.written(df)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a kernel that turns one batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield kernel(batch)

    return df.mapInArrow(run, schema)


def words(text):
    """Column: array of the words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def bind(value, fn):
    """Evaluate the column `value` once and pass it on: fn sees a lambda variable, not the expression again."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def free_prefix(columns: Sequence[str], prefix: str) -> str:
    """The prefix, lengthened until no column begins with it (column names are equal in any case)."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix += "_"
    return prefix


def named(c: str) -> Column:
    """A column by its name as it is, dots and all."""
    return F.col(f"`{c.replace('`', '``')}`")


__all__ = ["SPACES", "SPLIT", "arrow_map", "bind", "discard", "free_prefix", "named", "scratch", "settings", "shared_dir", "slices", "table", "words", "written"]
