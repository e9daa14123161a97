"""Quality summaries of sequencing reads (``rec, id, seq, strand, qual``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_by_position(reads: DataFrame) -> DataFrame:
    """``pos, mean, std, reads``."""
    rows = reads.select(F.posexplode("qual").alias("pos", "q"))
    return rows.groupBy("pos").agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), F.count(F.lit(1)).alias("reads"))


def bases_by_position(reads: DataFrame) -> DataFrame:
    """``pos, base, count``."""
    return reads.where("seq <> ''").select(F.posexplode(F.split(F.upper("seq"), "(?!$)")).alias("pos", "base")).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("count"))


def duplicates(reads: DataFrame, *, most: int = 499) -> DataFrame:
    """``copies, sequences``: how many sequences occur so often; counts from ``most`` on are one class."""
    each = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.least("n", F.lit(most)).alias("copies")).agg(F.count(F.lit(1)).alias("sequences"))


def uniqueness(reads: DataFrame) -> DataFrame:
    """``unique, repeated, percent_unique``: how many different sequences occur once and more often."""
    each = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    counts = each.agg(F.count_if(F.col("n") == 1).alias("unique"), F.count_if(F.col("n") > 1).alias("repeated"))
    return counts.withColumn("percent_unique", F.try_divide(F.col("unique") * 100.0, F.col("unique") + F.col("repeated")))
