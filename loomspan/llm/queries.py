"""Queries of the training-data problems and their oracle SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.loci import with_locus
from loomspan.llm.leakage import find_leaks
from loomspan.llm.overlap_sizes import overlap_sizes
from loomspan.llm.packing import fill_containers, token_lengths
from loomspan.llm.profile_clusters import describe_clusters, profile_clusters
from loomspan.llm.quantiles import combine, percentiles, summaries
from loomspan.llm.subject_areas import subject_shares
from loomspan.plans.general import list_name, table


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_locus(table(spark, sf_dir, "testc").select(list_name().alias("list"), "loc"), "loc")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lists that share at least 30 % of the loci of the smaller one."""
    pairs = overlap_sizes(memberships(spark, sf_dir), "list", ["chrom", "left", "right"])
    return pairs.where(F.col("shared") >= 0.3 * F.least("size_a", "size_b")).select("name_a", "name_b")


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap size of every pair of lists with a common locus."""
    return overlap_sizes(memberships(spark, sf_dir), "list", ["chrom", "left", "right"])


P1_SQL = r"""
with t as (select lower(trim(name)) as name, lower(regexp_replace(loc, '[\s,\x{00A0}]', '', 'g')) as s from testc),
u as (select distinct name, 'chr' || upper(regexp_extract(s, '^(chr)?([^:]+):', 2)) as chrom,
             try_cast(regexp_extract(s, ':(\d+)-(\d+)$', 1) as bigint) as l, try_cast(regexp_extract(s, ':(\d+)-(\d+)$', 2) as bigint) as r
      from t where regexp_full_match(s, '(chr)?[^:]+:\d+-\d+') and name <> ''),
v as (select * from u where l <= r), n as (select name, count(*) as size from v group by name),
p as (select a.name as name_a, b.name as name_b, count(*) as shared from v a join v b on a.chrom = b.chrom and a.l = b.l and a.r = b.r and a.name < b.name group by 1, 2)
"""
P1_SIZES = P1_SQL + "select name_a, name_b, x.size as size_a, y.size as size_b, shared from p join n x on x.name = name_a join n y on y.name = name_b"
P1_FOUND = P1_SQL + "select name_a, name_b from p join n x on x.name = name_a join n y on y.name = name_b where shared >= 0.3 * least(x.size, y.size)"


def measured(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """Groups and arrays of both tables with numeric entries."""
    day = lambda c: [F.to_date(c).alias("day")] if by_day else []
    mass = table(spark, sf_dir, "massspec").select(F.lit("massspec").alias("src"), F.col("sample_name").alias("grp"), *day("run_at"), F.col("intensities").alias("entries"))
    matrix = table(spark, sf_dir, "format_matrix").select(F.lit("format_matrix").alias("src"), F.col("study").alias("grp"), *day("measured_at"), F.col("conditions").alias("entries"))
    return mass.unionByName(matrix).where("grp is not null")


SHARES = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose 99th percentile is at least 30 times the median."""
    got = percentiles(summaries(measured(spark, sf_dir), ["src", "grp"], "entries"), SHARES)
    return got.where("p99 >= 30 * median").select("src", "grp")


def p6_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per group from summaries made per day and combined afterwards."""
    daily = summaries(measured(spark, sf_dir, by_day=True), ["src", "grp", "day"], "entries")
    return percentiles(combine(daily, ["src", "grp"]), SHARES)


def p6_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the combined daily percentiles keep their bound: a rank error of 3 % of the distance from the top, and two values."""
    entries = measured(spark, sf_dir).select("src", "grp", F.explode("entries").alias("v")).where("v > 0 and not isnan(v) and v < double('Infinity')")
    joined = entries.join(p6_daily(spark, sf_dir).select("src", "grp", "n", *SHARES), ["src", "grp"])
    counts = joined.groupBy("src", "grp").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), *[F.count_if(F.col("v") < F.col(c)).alias(f"{c}_below") for c in SHARES], *[F.count_if(F.col("v") <= F.col(c)).alias(f"{c}_upto") for c in SHARES])
    off = lambda c, q: F.greatest(F.col(f"{c}_below") / F.col("m") - q, q - F.col(f"{c}_upto") / F.col("m"))
    fine = [off(c, q) <= 0.03 * (1 - q) + 2 / F.col("m") for c, q in SHARES.items()]
    return counts.select("src", "grp", "n", functools.reduce(lambda a, b: a & b, fine).alias("within"))


P6_WITHIN = """
with t as (select 'massspec' as src, sample_name as grp, unnest(intensities) as v from massspec
           union all select 'format_matrix', study, unnest(conditions) from format_matrix)
select src, grp, count(*) as n, true as within from t where v > 0 and isfinite(v) and grp is not null group by src, grp
"""
P6_FOUND = """
with t as (select 'massspec' as src, sample_name as grp, unnest(intensities) as v from massspec
           union all select 'format_matrix', study, unnest(conditions) from format_matrix)
select src, grp from t where v > 0 and isfinite(v) and grp is not null group by src, grp having quantile_disc(v, 0.99) >= 30 * quantile_disc(v, 0.5)
"""


P8_FOUND = r"""
with t as (select 1 as kind, doc_id as id, text from documents union all select 2, item_id, text from eval_items),
n as (select kind, id, replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '</?(b|i|em|strong|u|span)>', '', 'g'), '<[a-zA-Z/][^<>]*>', ' ', 'g'), '&nbsp;', ' ') as s from t),
w as (select kind, id, regexp_extract_all(lower(regexp_replace(s, '(\pL)-[ \t]*\r?\n[ \t>|*#]*(\pL)', '\1\2', 'g')), '[\pL\pN]+') as ws from n),
g as (select kind, id, array_to_string(ws[i:i + 11], ' ') as g from (select kind, id, ws, unnest(range(1, len(ws) - 10)) as i from w))
select distinct a.id as doc_id, b.id as item_id from g a join g b on a.kind = 1 and b.kind = 2 and a.g = b.g
"""


P3_SQL = """
with recursive e as (select rid, unnest(conditions) as v, unnest(range(len(conditions))) as i from format_matrix where rid is not null),
x as (select rid, i, log2(1 + v) as x from e where v > 0 and isfinite(v)),
p as (select a.rid as u, b.rid as w from x a join x b on a.i = b.i and a.rid < b.rid group by 1, 2 having count(*) >= 3 and corr(a.x, b.x) >= 0.9),
link as (select u, w from p union all select w, u from p),
reach as (select distinct u as rid, u as other from link union select reach.rid, link.w from reach join link on link.u = reach.other),
heads as (select rid, min(other) as head_rid from reach group by rid)
"""
P3_FOUND = P3_SQL + "select rid, head_rid from heads"
P3_PROFILES = P3_SQL + """, c as (select rid, i, x - avg(x) over (partition by rid) as x from x), z as (select rid, i, x / sqrt(sum(x * x) over (partition by rid)) as z from c),
h as (select head_rid, rid, i, z from z join heads using (rid)), s as (select head_rid, i, sum(z) as s from h group by all), n as (select head_rid, count(*) as size from heads group by 1),
r as (select h.head_rid, size, h.rid, round((sum(z * s) - 1) / (size - 1), 9) as r from h join s on s.head_rid = h.head_rid and s.i = h.i join n on n.head_rid = h.head_rid group by h.head_rid, size, h.rid),
k as (select *, row_number() over (partition by head_rid order by r desc, rid) as place from r)
select head_rid, size, place, rid, round(r, 6) as r from k where place <= 3"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of clusters with two or more members."""
    return profile_clusters(table(spark, sf_dir, "format_matrix")).select("rid", "head_rid")


def p3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of every cluster."""
    records = table(spark, sf_dir, "format_matrix")
    return describe_clusters(records, profile_clusters(records)).withColumn("r", F.round("r", 6))


def p7_containers(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", capacity: int = 2048) -> DataFrame:
    """The container of every document that isn't blank, by its length in tokens."""
    return fill_containers(token_lengths(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary), capacity=capacity)


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of an item with at most one edit in it, and the fewest edits."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("edits = 0").select("doc_id", "item_id")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject shares; the kind of an item names what introduces one ("Read the passage ...")."""
    items = table(spark, sf_dir, "eval_items").select(F.concat_ws(" ", "text", "kind").alias("text"))
    return subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), items, table(spark, sf_dir, "subjects"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least one in six sentences of a document are about."""
    return shares(spark, sf_dir).where(F.col("sentences") * 6 >= F.col("of")).select("doc_id", "subject")


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus: documents and sentences by subject."""
    about = F.col("sentences") * 6 >= F.col("of")
    return shares(spark, sf_dir).groupBy("subject").agg(F.count_if(about).alias("documents"), F.sum("sentences").alias("sentences"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_sizes": p1_sizes, "p6_found": p6_found, "p6_daily": p6_daily, "p6_within": p6_within, "p7_containers": p7_containers, "p8_found": p8_found, "p8_near": p8_near, "p3_found": p3_found, "p3_profiles": p3_profiles, "p9_found": p9_found, "p9_corpus": p9_corpus}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_sizes": P1_SIZES, "p6_found": P6_FOUND, "p6_within": P6_WITHIN, "p8_found": P8_FOUND, "p3_found": P3_FOUND, "p3_profiles": P3_PROFILES}
