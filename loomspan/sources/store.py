"""A feature store of transcripts: one Parquet table, a folder per chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.loci import MINUS, PLUS


def add_features(features: DataFrame, path: str) -> None:
    """Append features (``loc, cds_loc, exon_starts, exon_ends, name, strand, feature_type``); strands become + or -, others null."""
    strand = F.when(F.col("strand").isin(*PLUS), "+").when(F.col("strand").isin(*MINUS), "-")
    rows = features.select(
        F.col("loc.chrom").alias("chrom"), F.col("loc.left").alias("transcript_left"), F.col("loc.right").alias("transcript_right"), F.col("cds_loc.left").alias("cds_left"), F.col("cds_loc.right").alias("cds_right"),
        "exon_starts", "exon_ends", "name", strand.alias("strand"), "feature_type",
    )
    rows.repartition("chrom", F.shiftright("transcript_left", 26)).sortWithinPartitions("chrom", "transcript_left").write.mode("append").partitionBy("chrom").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def features_at(store: DataFrame, chrom: str, left: int, right: int) -> DataFrame:
    """Features that overlap a closed interval: the chromosome is a folder, the bounds reach the scan."""
    return store.where((F.col("chrom") == chrom) & (F.col("transcript_right") >= left) & (F.col("transcript_left") <= right))


def find(store: DataFrame, name: str) -> DataFrame:
    return store.where(F.col("name") == name)


def by_feature(store: DataFrame, feature_type: str) -> DataFrame:
    """Features of one type."""
    return store.where(F.col("feature_type") == feature_type)


def by_key(store: DataFrame, key: str, value) -> DataFrame:
    """Features whose ``key`` is ``value``; an unknown key is an error."""
    if key not in store.columns:
        raise ValueError(f"the store has no {key!r}")
    return store.where(F.col(key) == value)


def has_chromosome(store: DataFrame, chrom: str) -> bool:
    """Whether the store holds a chromosome, written with or without ``chr``: its folder is looked up, no more is read than one row."""
    bare = chrom[3:] if chrom.lower().startswith("chr") else chrom
    return not store.where(F.col("chrom").isin(f"chr{bare}", bare)).isEmpty()


def write_info(spark: SparkSession, path: str, **facts) -> None:
    """Keep named facts (text) beside a table; those of the same name are replaced."""
    whole = {**read_info(spark, path), **{k: str(v) for k, v in facts.items()}}
    spark.createDataFrame(sorted(whole.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_info")


def read_info(spark: SparkSession, path: str) -> dict[str, str]:
    """The facts kept by ``write_info``; none if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/_info").collect()}  # a few facts
    except AnalysisException:
        return {}


def chromosomes(store: DataFrame) -> DataFrame:
    """``chrom, num_features``."""
    return store.groupBy("chrom").agg(F.count(F.lit(1)).alias("num_features"))
