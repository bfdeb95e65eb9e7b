"""A function is fixed, so a stream is looked up by a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recsplit import Model, lookup


def lookup_stream(model: Model, stream: DataFrame, key: str, out: str = "idx") -> DataFrame:
    return lookup(model, stream, key, out)


def windowed_counts(model: Model, stream: DataFrame, key: str, ts: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Dense counters over tumbling windows, with a watermark for late rows."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return lookup(model, rows, key).groupBy(F.window(ts, window), "idx").agg(F.count("*").alias("cnt"))
