"""Queries of the general data problems: covered periods, failing lines, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.loci import normal_chrom, with_locus
from loomspan.operators.packed import unpack_fields
from loomspan.operators.periods import covered_and_gaps
from loomspan.sources.rejects import parse_lines, rejected, valid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_name(name: str = "name") -> F.Column:
    """List names compare trimmed and in lower case; blank names are null."""
    text = F.lower(F.trim(F.col(name)))
    return F.when(text != "", text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of the lists per chromosome and of the genes."""
    named = table(spark, sf_dir, "testc").select(list_name().alias("name"), "loc")
    lists = with_locus(named, "loc").select(F.lit("testc").alias("src"), "name", "chrom", "left", "right")
    genes = table(spark, sf_dir, "genome_sql").select(
        F.lit("genome_sql").alias("src"),
        "name",
        normal_chrom(F.col("chrom")).alias("chrom"),
        F.col("transcript_left").alias("left"),
        F.col("transcript_right").alias("right"),
    )
    return covered_and_gaps(lists.unionByName(genes), ["src", "name", "chrom"], "left", "right")


P2_SQL = r"""
with t as (select lower(trim(name)) as name, lower(regexp_replace(loc, '[\s,\x{00A0}]', '', 'g')) as s from testc),
u as (select 'testc' as src, name, 'chr' || upper(regexp_extract(s, '^(chr)?([^:]+):(\d+)-(\d+)$', 2)) as chrom,
             try_cast(regexp_extract(s, ':(\d+)-(\d+)$', 1) as bigint) as l, try_cast(regexp_extract(s, ':(\d+)-(\d+)$', 2) as bigint) as r
      from t where regexp_full_match(s, '(chr)?[^:]+:\d+-\d+') and name <> ''
      union all
      select 'genome_sql', name, 'chr' || upper(regexp_replace(lower(trim(chrom)), '^chr', '')), transcript_left, transcript_right from genome_sql),
v as (select src, name, chrom, l, r, max(r) over (partition by src, name, chrom order by l, r rows between unbounded preceding and 1 preceding) as reach
      from (select distinct src, name, chrom, l, r from u) where l is not null and r is not null and l <= r and name is not null),
w as (select *, sum(case when reach is null or l > reach + 1 then 1 else 0 end) over (partition by src, name, chrom order by l, r rows unbounded preceding) as n from v),
p as (select src, name, chrom, min(l) as lo, max(r) as hi from w group by src, name, chrom, n),
g as (select src, name, chrom, hi + 1 as lo, lead(lo) over (partition by src, name, chrom order by lo) - 1 as hi from p)
select src, name, chrom, 'covered' as kind, lo, hi from p
union all select src, name, chrom, 'gap', lo, hi from g where hi is not null
"""


P4_SQL = r"""
with t as (select rec_id, fmt, rtrim(line, chr(13) || chr(10)) as line from format_lines),
r as (select * from t where trim(line, ' ' || chr(9) || chr(13)) <> '' and not regexp_matches(ltrim(line, ' ' || chr(9)), '^(#|track |browser )')
      and not (fmt = 'csv' and regexp_full_match(lower(replace(line, '"', '')), '\s*loc\s*,\s*name\s*,\s*score\s*,\s*strand\s*'))),
f as (select *, fmt = 'bed' or regexp_full_match(line, '([ \t]*"([^"]|"")*"[ \t]*|[^",]*)(,([ \t]*"([^"]|"")*"[ \t]*|[^",]*))*') as quoted,
      case when fmt = 'bed' then string_split(line, chr(9)) else regexp_extract_all(',' || line, ',([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)', 1) end as c from r),
g as (select *, len(c) as n, trim(trim(c[len(c)], ' ' || chr(9)), '"') as strand, trim(trim(trim(c[len(c) - 1], ' ' || chr(9)), '"'), ' ' || chr(9)) as score,
      lower(case when fmt = 'bed' then trim(c[1]) || ':' || trim(c[2]) || '-' || trim(c[3]) else regexp_replace(trim(trim(c[1], ' ' || chr(9)), '"'), '\s*([:-])\s*', '\1', 'g') end) as loc from f),
h as (select *, replace(regexp_extract(loc, ':([0-9,]*)-', 1), ',', '') as l, replace(regexp_extract(loc, '-([0-9,]*)$', 1), ',', '') as u,
      regexp_full_match(loc, '(chr)?[a-z0-9_]+:' || (case when fmt = 'csv' then '[0-9][0-9,]*-[0-9][0-9,]*' else '[0-9]+-[0-9]+' end)) and not regexp_matches(loc, '^chr:') as shaped from g)
select rec_id, reason from (select rec_id, case when not quoted then 'quoting' when n <> (case when fmt = 'bed' then 6 else 4 end) then 'column_count'
   when not shaped or try_cast(l as bigint) > try_cast(u as bigint) then 'loc'
   when not (regexp_full_match(score, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(score as double) between 0 and 1000) then 'score'
   when trim(strand, ' ' || chr(9)) not in ('+', '1', 'f', 'F', '-', '-1', '0', 'r', 'R', '.') then 'strand' end as reason from h) where reason is not null
"""


_TRIM = lambda x: f"trim({x}, ' ' || chr(9))"
P4_LOADED = P4_SQL[: P4_SQL.rindex("select rec_id, reason from")] + f"""select rec_id, 'chr' || upper(regexp_replace(split_part(loc, ':', 1), '^chr', '')) as chrom, cast(l as bigint) as left, cast(u as bigint) as right,
   case when fmt = 'bed' then {_TRIM("c[4]")} when {_TRIM("c[2]")}[1] = '"' then {_TRIM(f"replace({_TRIM('c[2]')}[2:-2], '" + '""' + "', '" + '"' + "')")} else {_TRIM("c[2]")} end as name, cast(score as double) as score, {_TRIM("strand")} as strand
   from h where quoted and n = (case when fmt = 'bed' then 6 else 4 end) and shaped and try_cast(l as bigint) <= try_cast(u as bigint)
   and regexp_full_match(score, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') and try_cast(score as double) between 0 and 1000 and {_TRIM("strand")} in ('+', '1', 'f', 'F', '-', '-1', '0', 'r', 'R', '.')"""


def _items_sql(field: str, table: str, key: str, pattern: str, text: str) -> str:
    return f"""select '{field}' as field_name, {key} as row_id, cast(i as integer) as pos, replace(trim(case when v[1] in ('"', chr(39)) then v[2:-2] else v end), '""', '"') as item
     from (select {key}, unnest(vs) as v, unnest(range(1, len(vs) + 1)) as i from (select {key}, list_filter(list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: trim(x)), lambda x: x <> '') as vs from {table}) where len(vs) > 1)"""


_NUMBERS = r""""[^"]*"|\x27[^\x27]*\x27|[^,;|\s"\x27]+"""
P5_SQL = " union all ".join(
    [
        *[_items_sql(c, "genome_sql", "feature_id", _NUMBERS, f"translate({c}, '[]', '')") for c in ("exonstarts", "exonends")],
        _items_sql("name", "massspec", "row_id", r'''"(?:[^"]|"")*"|[^,;|"]+''', "regexp_replace(name, ' / ', ';', 'g')"),
    ]
)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fail to parse, with the first reason that applies."""
    return rejected(parse_lines(table(spark, sf_dir, "format_lines")))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as typed columns."""
    return valid(parse_lines(table(spark, sf_dir, "format_lines")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of each packed exon or protein name field with more than one value."""
    exons = unpack_fields(table(spark, sf_dir, "genome_sql"), "feature_id", {"exonstarts": True, "exonends": True})
    return exons.unionByName(unpack_fields(table(spark, sf_dir, "massspec"), "row_id", {"name": False}))


def queries() -> dict:
    return {"p2_found": p2_found, "p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p4_found": P4_SQL, "p4_loaded": P4_LOADED, "p5_found": P5_SQL}
