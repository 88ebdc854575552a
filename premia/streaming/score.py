"""Scoring and monitoring streams. A model's score is a column expression, so it runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from premia.model import Model


def score_stream(stream: DataFrame, model: Model, offset=None, name: str = "prediction") -> DataFrame:
    """The stream with its predictions; stateless."""
    return model.predict(stream, offset, name)


def drift(stream: DataFrame, model: Model, y: str, time: str, window: str = "1 hour", watermark: str = "2 hours", weight: str | None = None, offset=None) -> DataFrame:
    """Rows, weight, observed, predicted and mean deviance for each event-time window; late rows up to the watermark."""
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    obs = F.col(f"`{y}`").cast("double")
    scored = model.predict(stream, offset, "__mu").withWatermark(time, watermark)
    g = scored.groupBy(F.window(time, window)).agg(F.count("*").alias("n_rows"), F.sum(w).alias("weight"), F.sum(w * obs).alias("o"), F.sum(w * F.col("__mu")).alias("p"), F.sum(w * model.family.deviance(obs, F.col("__mu"))).alias("d"))
    return g.select(F.col("window.start").alias("window_start"), "n_rows", "weight", (F.col("o") / F.col("weight")).alias("observed"), (F.col("p") / F.col("weight")).alias("predicted"), (F.col("d") / F.col("weight")).alias("mean_deviance"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all available input as Parquet and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
