"""Domain objects made from the star-schema tables, in Spark and in the oracle's SQL, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.loci import loc, tss
from loomspan.operators.matrix import to_columns, to_wide
from loomspan.plans.general import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


PEAKS = """peaks as (select o_orderkey as rid, concat('chr', o_custkey % 5) as chrom, (o_orderkey * 7919) % 1000000 as lo,
 (o_orderkey * 7919) % 1000000 + 50 + o_custkey % 450 as hi, o_totalprice as score, o_orderpriority as list from orders)"""
GENES = """genes as (select c_custkey as gid, concat('chr', c_custkey % 5) as chrom, (c_custkey * 15485863) % 1000000 as lo,
 (c_custkey * 15485863) % 1000000 + 100 + c_custkey % 400 as hi, case when c_custkey % 2 = 0 then '+' else '-' end as strand, c_name as name from customer)"""
TSS = f"{GENES}, starts as (select *, case when strand = '+' then lo else hi end as tss from genes)"


def peaks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    left = (F.col("o_orderkey") * 7919) % 1000000
    span = loc(F.concat(F.lit("chr"), F.col("o_custkey") % 5), left, left + 50 + F.col("o_custkey") % 450)
    return o.select(F.col("o_orderkey").alias("rid"), span.alias("loc"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("list"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    left = (F.col("c_custkey") * 15485863) % 1000000
    span = loc(F.concat(F.lit("chr"), F.col("c_custkey") % 5), left, left + 100 + F.col("c_custkey") % 400)
    strand = F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("-")
    out = c.select(F.col("c_custkey").alias("gid"), span.alias("loc"), strand.alias("strand"), F.col("c_name").alias("name"))
    return out.withColumn("tss_loc", tss(F.col("loc"), F.col("strand")))


def flat(df: DataFrame, key: str = "loc") -> DataFrame:
    """A locus column as chrom, lo, hi."""
    rest = [c for c in df.columns if c != key]
    return df.select(*rest, F.col(f"{key}.chrom").alias("chrom"), F.col(f"{key}.left").alias("lo"), F.col(f"{key}.right").alias("hi"))


READS = """reads as (select concat('chr', l_suppkey % 5) as chrom, (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 as lo,
 (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 + 20 + cast(l_quantity as bigint) * 4 as hi, case when l_partkey % 2 = 0 then '+' else '-' end as strand from lineitem)"""


SWEEP = """e as (select chrom, p, sum(v) as v from (select chrom, lo as p, 1 as v from reads union all select chrom, hi, -1 from reads) group by all),
 t0 as (select chrom, p as s, lead(p) over (partition by chrom order by p) as e, sum(v) over (partition by chrom order by p) as value from e), track as (select chrom, s, e, value from t0 where value <> 0)"""


def reads(spark: SparkSession, d: str) -> DataFrame:
    left = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000000
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("chrom"), left.alias("left"), (left + 20 + F.col("l_quantity").cast("bigint") * 4).alias("right"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand")
    )


#: Conditions of the matrix.
NAMES = ["AF", "AO", "NF", "NO", "RF", "RO"]
MATRIX = "m as (select l_suppkey as rid, " + ", ".join(f"cast(coalesce(sum(case when concat(l_returnflag, l_linestatus) = '{n}' then l_quantity end), 0) as double) as {n}" for n in NAMES) + " from lineitem group by l_suppkey)"
LONG = f"{MATRIX}, long as (" + " union all ".join(f"select rid, {i} as ix, '{n}' as cond, {n} as value from m" for i, n in enumerate(NAMES)) + ")"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rid"), F.concat("l_returnflag", "l_linestatus").alias("cond"), F.col("l_quantity").alias("value"))
    return to_wide(rows, NAMES, ["rid"])


def columns(df: DataFrame, names: list[str] = NAMES, digits: int | None = 6) -> DataFrame:
    """Array values as rounded columns."""
    out = to_columns(df, names)
    return out.select(*[F.round(c, digits).alias(c) if digits is not None and c in names else F.col(c) for c in out.columns])


def cells(f: str, names: list[str] = NAMES) -> str:
    """SQL of one expression per condition; ``{}`` is its column."""
    return ", ".join(f"round({f.replace('{}', n)}, 6) as {n}" for n in names)


_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
DNA = f"dna as (select * from (select doc_id as rid, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') as seq from documents) where seq <> '')"


def dna(spark: SparkSession, d: str) -> DataFrame:
    """Sequences made of the letters of whole texts; texts without a letter give none."""
    word = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _BASES)
    return table(spark, d, "documents").select(F.col("doc_id").alias("rid"), word.alias("seq")).where("seq <> ''")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
