"""Streaming forms of the list operators (an extension: the batch operators, on unbounded input)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.loci import overlaps
from loomspan.operators.intervals import bin_pairs


def interval_join(stream: DataFrame, features: DataFrame, stream_loc: Column, feature_loc: Column, *, bin_size: int = 10_000) -> DataFrame:
    """Stream rows with each static feature they overlap: structs ``a`` and ``b``. Stateless, so no watermark is needed."""
    a = stream.withColumn("_loc", stream_loc)
    b = features.withColumn("_loc", feature_loc)
    return bin_pairs(a, b, F.col("_loc"), F.col("_loc"), bin_size=bin_size).where(overlaps(F.col("a._loc"), F.col("b._loc")))


def key_join(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    return stream.join(static, key)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], *, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, keys..., count, total`` per tumbling window; rows later than ``late`` behind the watermark don't count."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "count", "total")


def sessions(stream: DataFrame, time: str, keys: list[str], *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("count")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "count")


def distinct_events(stream: DataFrame, time: str, keys: list[str], *, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
