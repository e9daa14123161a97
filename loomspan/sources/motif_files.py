"""Motif collections in the common text layouts; small files, read as whole records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.readers import read_homer_motifs  # noqa: F401  (the fifth layout)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")


def _numbers(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(r"(-?\d+\.?\d*(?:[eE][-+]?\d+)?)"), 1), lambda x: x.cast("double"))


def _turned(rows: Column) -> Column:
    """Four rows (A C G T) of places to one row of four per place."""
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))


def read_jaspar(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, matrix`` of ``>id name`` records with four rows of counts."""
    text = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    rows = F.transform(F.slice(_lines(F.col("value")), 2, 4), _numbers)
    head = F.split(F.trim(_lines(F.col("value"))[0]), r"\s+")
    return text.select(head[0].alias("id"), F.coalesce(F.get(head, 1), head[0]).alias("name"), _turned(rows).alias("matrix"))


def read_acgt_rows(spark: SparkSession, path: str) -> DataFrame:
    """``name, matrix`` of records with a name line and rows that begin with A, C, G and T."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.split("value", r"\r?\n\s*\r?\n")).alias("b")).where(F.trim("b") != "").select(_lines(F.col("b")).alias("l"))
    base = lambda c: F.get(F.filter("l", lambda x: x.rlike(rf"^\s*{c}\s*[:|\s]")), 0)
    rows = F.array(*[_numbers(F.regexp_replace(base(c), rf"^\s*{c}\s*[:|]?", "")) for c in "ACGT"])
    return blocks.where(F.size("l") >= 5).select(F.trim(F.regexp_replace(F.col("l")[0], "^>", "")).alias("name"), _turned(rows).alias("matrix"))


def read_transfac(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, matrix`` of records closed by ``//`` with ``ID``/``NA`` lines and numbered rows of counts."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.split("value", r"(?m)^//\s*$")).alias("b")).select(_lines(F.col("b")).alias("l"))
    field = lambda k: F.trim(F.regexp_replace(F.get(F.filter("l", lambda x: x.rlike(rf"^{k}\s")), 0), rf"^{k}\s+", ""))
    rows = F.transform(F.filter("l", lambda x: x.rlike(r"^\d+\s")), lambda x: F.slice(_numbers(F.regexp_replace(x, r"^\d+\s+", "")), 1, 4))
    return blocks.where(F.size(rows) > 0).select(field("ID").alias("id"), F.coalesce(field("NA"), field("ID")).alias("name"), rows.alias("matrix"))


def read_aligned_words(spark: SparkSession, path: str) -> DataFrame:
    """``matrix`` of base counts of aligned words, one per line, in the order A C G T."""
    words = spark.read.text(path).select(F.upper(F.trim("value")).alias("w")).where("w rlike '^[ACGTN]+$'")
    letters = words.select(F.posexplode(F.split("w", "(?!$)")).alias("pos", "base")).groupBy("pos").agg(F.array(*[F.count_if(F.col("base") == c).cast("double") for c in "ACGT"]).alias("n"))
    return letters.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda s: s["n"]).alias("matrix"))
