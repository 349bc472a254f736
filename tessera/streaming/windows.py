"""Windowed aggregates that take a batch frame or a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import active


def read_stream(path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return active().readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _watermarked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, time: str, every: str, aggs: Sequence[Column], by: Sequence[str] = (), period: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates of windows of `period` (by default `every`) that start each `every`. late: how long a stream waits."""
    window = F.window(time, period or every, every)
    out = _watermarked(df, time, late).groupBy(window, *by).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def session_windows(df: DataFrame, time: str, gap: str, aggs: Sequence[Column], by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """Aggregates of runs of rows with less than `gap` between them."""
    out = _watermarked(df, time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there to Parquet, batch after batch, and stop; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
