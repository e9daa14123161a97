"""Queries of the matrix, statistics, track, contact, sequence, mass-spec, learning and streaming operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomspan import streaming
from loomspan.functions import arrays
from loomspan.operators import contacts, intervals, learn, massspec, motifs, stats, tracks
from loomspan.operators import matrix as mx
from loomspan.operators import rows as row_ops
from loomspan.plans.base import DNA, GENES, LONG, MATRIX, NAMES, ORACLE, PEAKS, QUERIES, READS, SWEEP, cells, columns, dna, genes, matrix, peaks, query, reads
from loomspan.plans.general import table
from loomspan.plans.list_queries import PRIORITIES

M = f"with {MATRIX} select rid, "
SUM = " + ".join(NAMES)
MEAN = f"(({SUM}) / 6)"
VAR = "((" + " + ".join(f"({n} - {MEAN}) * ({n} - {MEAN})" for n in NAMES) + ") / 6)"


def simple(name: str, f, sql: str) -> None:
    """A row-wise operator on the matrix and its SQL per condition."""

    def run(spark, d):
        return columns(f(matrix(spark, d)))

    QUERIES[name] = run
    ORACLE[name] = f"{M}{cells(sql)} from m"


simple("matrix_log", lambda m: mx.log(m, 2), "log2({} + 0.1)")
simple("matrix_unlog", lambda m: mx.unlog(mx.mult(m, 0.001), 2), "pow(2.0, {} * 0.001 + 0.1)")
simple("matrix_mult", lambda m: mx.mult(m, 1.5), "{} * 1.5")
simple("matrix_add", lambda m: mx.plus(m, 2.5), "{} + 2.5")
simple("matrix_sub", lambda m: mx.minus(m, 2.5), "{} - 2.5")
simple("matrix_abssub", lambda m: mx.abssub(m, 100), "greatest({} - 100, 0.0)")
simple("matrix_bracket", lambda m: mx.bracket(m, 500, 3000), "least(greatest({}, 500), 3000)")
simple("matrix_row_z", mx.row_z, f"case when sqrt({VAR}) > 0 then ({{}} - {MEAN}) / sqrt({VAR}) else 0 end")
simple("matrix_normalize_rows", mx.normalize_rows, f"coalesce(({{}} - least({', '.join(NAMES)})) / nullif(greatest({', '.join(NAMES)}) - least({', '.join(NAMES)}), 0), 0)")
simple("matrix_coerce", lambda m: mx.coerce(mx.coerce(mx.mult(m, 0.37), "bigint"), "double"), "trunc({} * 0.37)")


@query(f"with {MATRIX}, s as (select * from m), w as (select {', '.join(f'avg({n}) as m_{n}, stddev_pop({n}) as s_{n}, min({n}) as l_{n}, max({n}) as h_{n}' for n in NAMES)} from m) select rid, " + ", ".join(f"round(({n} - m_{n}) / s_{n}, 6) as {n}" for n in NAMES) + " from s, w")
def matrix_column_z(spark, d):
    return columns(mx.column_z(matrix(spark, d), NAMES))


_W = f"with {MATRIX}, w as (select {', '.join(f'avg({n}) as m_{n}, stddev_pop({n}) as s_{n}, min({n}) as l_{n}, max({n}) as h_{n}' for n in NAMES)} from m) select rid, "


@query(_W + ", ".join(f"round({n} - m_{n}, 6) as {n}" for n in NAMES) + " from m, w")
def matrix_subtract_mean(spark, d):
    return columns(mx.subtract_mean(matrix(spark, d), NAMES))


@query(_W + ", ".join(f"round({n} / s_{n}, 6) as {n}" for n in NAMES) + " from m, w")
def matrix_whiten(spark, d):
    return columns(mx.whiten(matrix(spark, d), NAMES))


@query(_W + ", ".join(f"round(1 - 2 * coalesce((h_{n} - {n}) / nullif(h_{n} - l_{n}, 0), 0), 6) as {n}" for n in NAMES) + " from m, w")
def matrix_normalize_columns(spark, d):
    return columns(mx.normalize_columns(matrix(spark, d), NAMES))


_G = f"with {LONG}, g as (select min(value) as lo, max(value) as hi, stddev_pop(value) as sd from long) select rid, "


@query(_G + cells("({} - lo) / (hi - lo)") + " from m, g")
def matrix_normalize(spark, d):
    return columns(mx.normalize(matrix(spark, d)))


@query(_G + cells("ceil(({} - lo) / (hi - lo) * 10)") + " from m, g")
def matrix_digitize(spark, d):
    return columns(mx.digitize(matrix(spark, d), 10))


@query(_G + cells(f"({{}} - {MEAN}) / sd") + " from m, g")
def matrix_row_z_global(spark, d):
    return columns(mx.row_z(matrix(spark, d), row_variance=False))


@query(f"with {LONG} select rid, ix, cond, value from long")
def matrix_to_long(spark, d):
    return mx.to_long(matrix(spark, d), NAMES, ["rid"])


@query(f"{M}RO, AF from m")
def slice_conditions(spark, d):
    return columns(mx.slice_conditions(matrix(spark, d), NAMES, ["RO", "AF"]), ["RO", "AF"])


def _fold(a: str, b: str) -> str:
    return f"case when {b} + 1e-6 > {a} + 1e-6 then log2(({b} + 1e-6) / ({a} + 1e-6)) else -log2(({a} + 1e-6) / ({b} + 1e-6)) end"


@query(f"{M}round({_fold('AF', 'NO')}, 6) as fc from m")
def add_fold_change(spark, d):
    return mx.add_fold_change(matrix(spark, d), NAMES, "AF", "NO").select("rid", F.round("fc", 6).alias("fc"))


@query(f"{M}" + ", ".join(f"round({_fold('AF', n)}, 6) as {n}" for n in NAMES[1:]) + " from m")
def normalise_to_condition(spark, d):
    out, names = mx.normalise_to_condition(matrix(spark, d), NAMES, "AF", use_fold_change=True)
    return columns(out, names)


@query(f"{M}" + ", ".join(f"round(pow(2.0, -((AF + 1e-6) / ({n} + 1e-6))), 6) as {n}" for n in NAMES[1:]) + " from m")
def normalise_to_condition_ratio(spark, d):
    out, names = mx.normalise_to_condition(matrix(spark, d), NAMES, "AF")
    return columns(out, names)


@query(f"{M}0.0 as AF, round({_fold('AF', 'AO')}, 6) as AO, 0.0 as NF, round({_fold('NF', 'NO')}, 6) as NO, 0.0 as RF, round({_fold('NF', 'RO')}, 6) as RO from m")
def norm_multi_fc(spark, d):
    return columns(mx.norm_multi_fc(matrix(spark, d), NAMES, {"AF": ["AO"], "NF": ["NO", "RO"]}))


@query(f"{M}(AF + AO) / 2 as AF, (NF + NO) / 2 as NF, RF, RO, round(abs(AF - AO) / 2 / sqrt(2), 6) as e0, round(abs(NF - NO) / 2 / sqrt(2), 6) as e1 from m")
def mean_replicates(spark, d):
    out, names = mx.mean_replicates(matrix(spark, d), NAMES, [["AF", "AO"], ["NF", "NO"]])
    return columns(out, names).select("rid", *names, F.round(F.col("err")[0], 6).alias("e0"), F.round(F.col("err")[1], 6).alias("e1"))


@query(f"with {MATRIX} select 'AF' as a, 'AO' as b, round(corr(AF, AO), 6) as r from m union all select 'NF', 'NO', round(corr(NF, NO), 6) from m")
def replicate_correlations(spark, d):
    return mx.replicate_correlations(matrix(spark, d), NAMES, [["AF", "AO"], ["NF", "NO"]]).withColumn("r", F.round("r", 6))


_OVER = lambda x: "(" + " + ".join(f"cast({n} > {x} as integer)" for n in NAMES) + ")"
_UNDER = lambda x: "(" + " + ".join(f"cast({n} < {x} as integer)" for n in NAMES) + ")"
for _name, _f, _sql in [
    ("keep_any_over", lambda m: mx.keep_any_over(m, 4000), f"{_OVER(4000)} > 0"),
    ("filter_low_expressed", lambda m: mx.keep_low_expressed(m, 3000, 3), f"{_OVER(3000)} >= 3"),
    ("filter_high_expressed", lambda m: mx.keep_high_expressed(m, 3000, 2), f"{_OVER(3000)} <= 2"),
    ("filter_by_mean", lambda m: mx.keep_by_mean(m, 2000, 2600), f"{MEAN} between 2000 and 2600"),
    ("filter_by_condition", lambda m: mx.keep_condition(m, NAMES, "NO", 2500), "NO >= 2500"),
    ("filter_low_and_high", lambda m: mx.keep_low_and_high(m, 1500, 3000, 3), f"{_UNDER(1500)} + {_OVER(3000)} >= 3"),
    ("filter_by_cv", lambda m: mx.keep_by_cv(m, 0.1, 1.0), f"sqrt({VAR}) / ({MEAN} + 0.1) > 0.1 and sqrt({VAR}) / ({MEAN} + 0.1) < 1.0"),
]:

    def _keep(spark, d, f=_f):
        return f(matrix(spark, d)).select("rid")

    QUERIES[_name] = _keep
    ORACLE[_name] = f"{M}from m where {_sql}".replace("rid, from", "rid from")


@query(f"{M}round({_fold('AF', 'NO')}, 6) as fc from m where abs({_fold('AF', 'NO')}) >= 0.2")
def filter_by_fc(spark, d):
    return mx.keep_by_fold(mx.add_fold_change(matrix(spark, d), NAMES, "AF", "NO"), value=0.2).select("rid", F.round("fc", 6).alias("fc"))


@query(f"{M}row_number() over (order by {SUM}, rid) - 1 as place from m")
def sort_sum(spark, d):
    return row_ops.with_ordinal(matrix(spark, d).withColumn("s", mx.total()), "place", ["s", "rid"]).select("rid", "place")


@query("select row_number() over (order by s) - 1 as place, name from (" + " union all ".join(f"select '{n}' as name, (with {MATRIX} select sum({n}) from m) as s" for n in NAMES) + ")")
def sort_columns_by_sum(spark, d):
    names = mx.columns_by_sum(matrix(spark, d), NAMES)
    return spark.createDataFrame(list(enumerate(names)), "place bigint, name string")


@query(f"with {LONG} select a.cond as a, b.cond as b, round(corr(a.value, b.value), 6) as r from long a join long b on a.rid = b.rid group by all")
def correlation_matrix(spark, d):
    return mx.correlation_matrix(matrix(spark, d), NAMES).withColumn("r", F.round("r", 6))


@query(
    f"""with {LONG}, c as (select a.cond as a, b.cond as b, corr(a.value, b.value) as r from long a join long b on a.rid = b.rid and a.cond <> b.cond group by all),
    k as (select *, row_number() over (partition by a order by r desc, b) as k from c where r >= -1) select a, b, round(r, 6) as r, r >= 0.9 as strong from k where k <= 2"""
)
def network_edges(spark, d):
    return mx.network_edges(matrix(spark, d), NAMES, low=-1.0, most_links=2).withColumn("r", F.round("r", 6))


_SEEDS = [("up", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("split", [1.0, 9.0, 1.0, 9.0, 1.0, 9.0])]


def _r_sql(p: list[float]) -> str:
    m = sum(p) / len(p)
    cov = " + ".join(f"({n} - {MEAN}) * {x - m}" for n, x in zip(NAMES, p))
    return f"(({cov}) / sqrt({VAR} * 6 * {sum((x - m) ** 2 for x in p)}))"


@query(
    f"with {MATRIX}, r as (select rid, {_r_sql(_SEEDS[0][1])} as u, {_r_sql(_SEEDS[1][1])} as s from m) select rid, case when u > s then 'up' else 'split' end as seed, round(greatest(u, s), 6) as r from r where greatest(u, s) > 0.5"
)
def bundle(spark, d):
    return mx.bundle(matrix(spark, d), _SEEDS, "rid", z=0.5).withColumn("r", F.round("r", 6))


@query(
    f"""with {LONG}, k as (select *, row_number() over (partition by ix order by value, rid) as k from long), a as (select k, avg(value) as v from k group by k),
    t as (select rid, cond, median(v) over (partition by ix, value) as v from k join a using (k))
    select rid, """ + ", ".join(f"round(max(case when cond = '{n}' then v end), 6) as {n}" for n in NAMES) + " from t group by rid"
)
def quantile_normalise(spark, d):
    return columns(mx.quantile_normalise(matrix(spark, d), NAMES, "rid"))


# --- statistics -------------------------------------------------------------------------------------


@query(f"with {LONG} select cond, min(value) as min, max(value) as max, sum(value) as sum, round(avg(value), 6) as mean, median(value) as median, round(stddev_pop(value), 6) as std from long group by cond")
def stats_summary(spark, d):
    out = stats.summary(matrix(spark, d), NAMES)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"with {LONG} select min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from long")
def stats_overall(spark, d):
    return stats.overall(matrix(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_T = f"with {MATRIX}, s as (select count(*) as n, avg(AF) as m1, avg(NO) as m2, var_samp(AF) as v1, var_samp(NO) as v2 from m) "


@query(_T + "select round((m1 - m2) / sqrt(v1 / n + v2 / n), 6) as t, round(pow(v1 / n + v2 / n, 2) / (pow(v1 / n, 2) / (n - 1) + pow(v2 / n, 2) / (n - 1)), 4) as df from s")
def ttest_welch(spark, d):
    return stats.ttest(matrix(spark, d), NAMES, "AF", "NO").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query(_T + "select round((m1 - m2) / sqrt((v1 + v2) / 2 * 2 / n), 6) as t, cast(2 * n - 2 as double) as df from s")
def ttest_student(spark, d):
    return stats.ttest(matrix(spark, d), NAMES, "AF", "NO", equal_var=True).select(F.round("t", 6).alias("t"), "df")


@query(f"with {MATRIX} select round(corr(AF, NO), 6) as r, count(*) as n from m")
def pearson(spark, d):
    return stats.pearsonr(matrix(spark, d), NAMES, "AF", "NO").withColumn("r", F.round("r", 6))




@query(f"with {MATRIX}, r as (select rank() over (order by AF) + (count(*) over (partition by AF) - 1) / 2.0 as x, rank() over (order by NO) + (count(*) over (partition by NO) - 1) / 2.0 as y from m) select round(corr(x, y), 6) as r, count(*) as n from r")
def spearman(spark, d):
    return stats.spearmanr(matrix(spark, d), NAMES, "AF", "NO").withColumn("r", F.round("r", 6))


def _pooled(some: str) -> str:
    return f"""with {LONG}, p as (select cond, value, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as k from long where cond in ({some})),
    g as (select cond, count(*) as n, sum(k) as r from p group by cond), t as (select sum(c * c * c - c) as t from (select cast(count(*) as double) as c from p group by value)), z as (select cast(count(*) as double) as n from p) """


@query(_pooled("'AF', 'NO', 'RF'") + "select round((12.0 / (z.n * (z.n + 1)) * sum(g.r * g.r / g.n) - 3 * (z.n + 1)) / (1 - t.t / (z.n * z.n * z.n - z.n)), 5) as h from g, z, t group by z.n, t.t")
def kruskal_h(spark, d):
    return stats.kruskal(matrix(spark, d), NAMES, ["AF", "NO", "RF"]).select(F.round("h", 5).alias("h"))


@query(_pooled("'AF', 'NO'") + "select round(max(case when cond = 'AF' then r - n * (n + 1) / 2.0 end), 4) as u from g")
def mannwhitney_u(spark, d):
    return stats.mannwhitney(matrix(spark, d), NAMES, "AF", "NO").select(F.round("u", 4).alias("u"))


@query(
    f"""with {MATRIX}, x as (select AF - NO as d from m where AF <> NO), k as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as k from x)
    select round(least(sum(case when d > 0 then k else 0 end), sum(case when d < 0 then k else 0 end)), 4) as w, count(*) as n from k"""
)
def wilcoxon_w(spark, d):
    return stats.wilcoxon(matrix(spark, d), NAMES, "AF", "NO").select(F.round("w", 4).alias("w"), "n")


@query("with o as (select o_orderkey, avg(o_totalprice) over (order by o_orderkey rows 19 preceding) as mean, row_number() over (order by o_orderkey) as n from orders) select o_orderkey, round(mean, 4) as mean from o where n > 20")
def running_mean(spark, d):
    return stats.running_mean(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 20).select("o_orderkey", F.round("mean", 4).alias("mean"))


@query(
    """with o as (select row_number() over (order by o_orderkey) - 1 as x, sum(o_totalprice) over (order by o_orderkey rows between 3 preceding and 1 following) as y, count(*) over () as n from orders)
    select x, round(y, 3) as y from o where x >= 3 and x < n - 2"""
)
def sliding_sum(spark, d):
    return stats.sliding_sum(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 5).withColumn("y", F.round("y", 3))


@query(
    """with v as (select l_discount as v from lineitem), h as (select stddev_samp(v) * pow(count(*), -0.2) as h from v), x as (select unnest([0.0, 0.05, 0.1]) as x),
    s as (select x, sum(exp(-0.5 * pow((x - v) / h, 2))) as y from x, v, h group by x) select cast(x as double) as x, round(y / sum(y) over (), 6) as density from s"""
)
def kernel_density(spark, d):
    return stats.density(table(spark, d, "lineitem"), "l_discount", 0.0, 0.1, 3).select(F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


# --- tracks -----------------------------------------------------------------------------------------

_SWEEP = SWEEP
_TRACK = f"with {READS}, {_SWEEP}"


def _track(spark, d):
    return tracks.coverage(reads(spark, d))


@query(f"{_TRACK} select chrom, s as start, e as \"end\", cast(value as bigint) as value from track")
def coverage_track(spark, d):
    return _track(spark, d)


@query(
    f"""with r0 as (select 1), {READS.replace('reads as', 'raw as')}, reads as (select chrom, case when strand = '-' then lo - 100 else lo end as lo, case when strand = '-' then hi else hi + 100 end as hi from raw), {_SWEEP}
    select chrom, s as start, e as "end", cast(value as bigint) as value from track"""
)
def coverage_extended(spark, d):
    return tracks.coverage(reads(spark, d), extend=100)


@query(
    f"""with {READS}, f as (select *, case when hi - lo < 50 then null when hi - lo <= 143 then 'sub_nucleosome' when hi - lo <= 286 then 'mono_nucleosome' else 'multi_nucleosome' end as track from reads),
    e as (select track, chrom, p, sum(v) as v from (select track, chrom, lo as p, 1 as v from f where track is not null union all select track, chrom, hi, -1 from f where track is not null) group by all),
    t as (select track, chrom, p, lead(p) over (partition by track, chrom order by p) as q, sum(v) over (partition by track, chrom order by p) as value from e)
    select track, chrom, p as start, q as "end", cast(value as bigint) as value from t where value <> 0"""
)
def fragment_tracks(spark, d):
    return tracks.fragment_tracks(reads(spark, d))


@query(f"{_TRACK} select chrom, greatest(s, 100000) as start, least(e, 110000) as \"end\", cast(value as bigint) as value from track where chrom = 'chr2' and e > 100000 and s < 110000")
def track_get(spark, d):
    return tracks.get(_track(spark, d), "chr2", 100000, 110000)


_CLIP = lambda lo, hi: f"c as (select g.*, greatest(s, {lo}) as a, least(e, {hi}) as b, {lo} as w0, value from genes g join track t on t.chrom = g.chrom and t.e > {lo} and t.s < {hi})"
_MID = "((g.lo + g.hi) >> 1)"


@query(
    f"""{_TRACK}, {GENES}, {_CLIP(f'({_MID} - 50)', f'({_MID} + 50)')}, o as (select unnest(range(0, 100)) as o),
    x as (select case when strand = '-' then 100 - (b - w0) else a - w0 end as f, case when strand = '-' then 100 - (a - w0) else b - w0 end as t, value from c)
    select o as "offset", round(coalesce(sum(value), 0) / (select count(*) from genes), 6) as value from o left join x on f <= o and o < t group by o"""
)
def pileup_profile(spark, d):
    return tracks.pileup(_track(spark, d), genes(spark, d), window=50).withColumn("value", F.round("value", 6))


@query(f"{_TRACK}, {GENES}, {_CLIP(f'({_MID} - 500)', f'({_MID} + 500)')} select g.gid, cast(coalesce(sum(value * (b - a)), 0) as double) as value from genes g left join c on c.gid = g.gid group by all")
def density_by_peak(spark, d):
    return tracks.density(_track(spark, d), genes(spark, d), key="gid", expand_by=500)


@query(f"{_TRACK}, {GENES}, {_CLIP(f'({_MID} - 500)', f'({_MID} + 500)')} select g.gid, cast(coalesce(max(value), 0) as double) as value from genes g left join c on c.gid = g.gid group by all")
def density_max(spark, d):
    return tracks.density(_track(spark, d), genes(spark, d), key="gid", expand_by=500, method="max")


@query(
    f"""{_TRACK}, {GENES}, {_CLIP(f'({_MID} - 1000)', f'({_MID} + 1000)')},
    f as (select gid, value, b > w0 + 900 and a < w0 + 1100 as inner_, greatest(0, least(b, w0 + 900) - a) + greatest(0, b - greatest(a, w0 + 1100)) as n from c),
    s as (select gid, max(case when inner_ then value end) as p, sum(value * n) / 1800.0 as m, sum(value * value * n) / 1800.0 as q from f group by gid)
    select g.gid, round(case when coalesce(p, 0) > 0 then (p - m) / greatest(sqrt(greatest(q - m * m, 0)), 0.001) else 0 end, 4) as z from genes g left join s on s.gid = g.gid"""
)
def enrichment_z(spark, d):
    return tracks.enrichment(_track(spark, d), genes(spark, d), key="gid", peak_window=100, local=1000).select("gid", F.round("z", 4).alias("z"))


@query(
    f"""{_TRACK}, {GENES}, {_CLIP(f'({_MID} - 1000)', f'({_MID} + 1000)')},
    f as (select gid, value, b > w0 + 900 and a < w0 + 1100 as inner_, greatest(0, least(b, w0 + 900) - a) + greatest(0, b - greatest(a, w0 + 1100)) as n from c),
    s as (select gid, max(case when inner_ then value end) as p, sum(value * n) / 1800.0 as m, sum(value * value * n) / 1800.0 as q from f group by gid),
    own as (select g.gid, coalesce(p, 0) as p, coalesce(m, 0) as m, sqrt(greatest(coalesce(q, 0) - coalesce(m, 0) * coalesce(m, 0), 0)) as d from genes g left join s on s.gid = g.gid), lim as (select median(m) + 1.2 * stddev_pop(m) as l from own)
    select gid, round(case when p > 0 then (p - m) / greatest(d, 0.001) else 0 end, 4) as z from own, lim where p > l and p > m + 1.2 * d"""
)
def redefine_peaks(spark, d):
    return tracks.redefine_peaks(_track(spark, d), genes(spark, d), key="gid", peak_window=100, local=1000).select("gid", F.round("z", 4).alias("z"))


@query(
    f"""{_TRACK}, {GENES}, {_CLIP(f'({_MID} - 500)', f'({_MID} + 500)')}, k as (select gid, a - w0 as a, b - w0 as b, value, unnest(range((a - w0) // 100, (b - w0 - 1) // 100 + 1)) as bin from c)
    select gid, bin, cast(sum(value * (least(b, (bin + 1) * 100) - greatest(a, bin * 100))) as double) as value from k where bin < 10 group by all"""
)
def heat_rows(spark, d):
    return tracks.heat_rows(_track(spark, d), genes(spark, d), key="gid", distance=500, bins=10).withColumn("value", F.col("value").cast("double"))


@query(
    f"""with {READS}, e as (select chrom, p, sum(v) as v from (select chrom, lo as p, w as v from (select *, 1 as w from reads union all select *, 2 from reads where strand = '+') union all select chrom, hi, -w from (select *, 1 as w from reads union all select *, 2 from reads where strand = '+')) group by all),
    t as (select chrom, p, lead(p) over (partition by chrom order by p) as q, sum(v) over (partition by chrom order by p) as value from e) select chrom, p as start, q as "end", cast(value as double) as value from t where value <> 0"""
)
def merge_tracks(spark, d):
    r = reads(spark, d)
    a = tracks.coverage(r).withColumn("track", F.lit("a")).withColumn("value", F.col("value").cast("double"))
    b = tracks.coverage(r.where("strand = '+'")).withColumn("track", F.lit("b")).withColumn("value", F.col("value") * 2.0)
    return tracks.merge_tracks(a.unionByName(b), "track")


@query(
    f"""with {PEAKS}, b as (select chrom, lo as p from peaks union select chrom, hi from peaks), s as (select chrom, p, lead(p) over (partition by chrom order by p) as q from b),
    h as (select s.chrom, s.p, s.q, arg_max(score, rid) as value from s join peaks k on k.chrom = s.chrom and k.lo <= s.p and s.p < k.hi group by all) select chrom, p as start, q as "end", value from h"""
)
def bedgraph_assign(spark, d):
    p = peaks(spark, d).select("rid", F.col("loc.chrom").alias("chrom"), F.col("loc.left").alias("left"), F.col("loc.right").alias("right"), "score")
    return tracks.assign(p)


_HEAT = "h as (select chrom, unnest(range(lo // 10, hi // 10)) as b, cast(floor((hi - lo) * 50 / 500) as integer) as y from reads where hi - lo < 500)"


@query(f"with {READS}, {_HEAT} select chrom, b as bin10, y as ybin, count(*) as value from h group by all")
def fragment_heat(spark, d):
    return tracks.heat_bins(reads(spark, d))


@query(
    f"""with {READS}, {GENES}, {_HEAT} select case when strand = '-' then -(h.b - {_MID} // 10) else h.b - {_MID} // 10 end as "offset", y as ybin, round(count(*) / (select count(*) from genes), 6) as value
    from h join genes g on g.chrom = h.chrom and abs(h.b - {_MID} // 10) <= 10 group by all"""
)
def heat_profile(spark, d):
    return tracks.heat_profile(tracks.heat_bins(reads(spark, d)), genes(spark, d), window=100).withColumn("value", F.round("value", 6))


@query(
    f"""{_TRACK}, {GENES}, g as (select * from genes where hi - lo >= 50), x as (select *, pt / 49.0 * (hi - lo - 1) as x from g, (select unnest(range(50)) as pt)),
    y as (select *, cast(floor(x) as bigint) as x0, least(cast(floor(x) as bigint) + 1, hi - lo - 1) as x1 from x),
    v as (select y.*, coalesce(s.value, 0) as v0, coalesce(t.value, 0) as v1 from y left join track s on s.chrom = y.chrom and s.s <= lo + x0 and lo + x0 < s.e left join track t on t.chrom = y.chrom and t.s <= lo + x1 and lo + x1 < t.e)
    select pt as point, round(sum(v0 + (v1 - v0) * (x - x0)) / (select count(*) from g), 6) as value from v group by pt"""
)
def scaled_profile(spark, d):
    return tracks.scaled_profile(_track(spark, d), genes(spark, d), points=50, key="gid").withColumn("value", F.round("value", 6))


# --- contacts ---------------------------------------------------------------------------------------

_CONTACTS = "contacts as (select concat('chr', l_linenumber % 3) as chrom, least(l_partkey, l_suppkey * 20) // 100 as i, greatest(l_partkey, l_suppkey * 20) // 100 as j, cast(count(*) as double) as score from lineitem group by all)"


def _contacts(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("chr"), F.col("l_linenumber") % 3).alias("chrom"), F.col("l_partkey").alias("left"), (F.col("l_suppkey") * 20).alias("right"))
    return contacts.from_pairs(li, 100)


@query(f"with {_CONTACTS} select * from contacts")
def contacts_binned(spark, d):
    return _contacts(spark, d)


@query(f"with {_CONTACTS}, e as (select chrom, j - i as d, avg(score) as x from contacts where score > 0 group by all) select c.chrom, i, j, score, round(x, 6) as expected, round(score / x, 6) as oe from contacts c join e on e.chrom = c.chrom and e.d = j - i")
def oe_expected(spark, d):
    return contacts.observed_expected(_contacts(spark, d)).select("chrom", "i", "j", "score", F.round("expected", 6).alias("expected"), F.round("oe", 6).alias("oe"))


@query(f"with {_CONTACTS} select j - i as d, sum(score) as total from contacts where chrom <> 'chr2' and j - i >= 1 and j - i < 8 group by all")
def contact_probability(spark, d):
    return contacts.contact_probability(_contacts(spark, d), 1, 8, skip=("chr2",))


@query(f"with {_CONTACTS}, {PEAKS}, l as (select rid, concat('chr', rid % 3) as chrom, least(rid % 20, rid % 17) as i, greatest(rid % 20, rid % 17) as j from peaks where abs(rid % 20 - rid % 17) >= 4) select rid, coalesce(score, 0) as strength from l left join contacts c using (chrom, i, j)")
def loop_strength(spark, d):
    p = peaks(spark, d)
    chrom = F.concat(F.lit("chr"), F.col("rid") % 3)
    at = lambda k: F.struct(chrom.alias("chrom"), ((F.col("rid") % k) * 100).alias("left"), ((F.col("rid") % k) * 100).alias("right"))
    loops = p.select("rid", at(20).alias("loc1"), at(17).alias("loc2"))
    return contacts.loop_strength(_contacts(spark, d), loops, 100)


@query(f"with {_CONTACTS}, f as (select chrom, i, j, score from contacts union all select chrom, j, i, score from contacts where i < j), a as (select distinct chrom, i as bin from contacts where i = j) select i - bin as di, j - bin as dj, round(sum(score) / (select count(*) from a), 6) as mean from f join a on a.chrom = f.chrom and abs(i - bin) <= 2 and abs(j - bin) <= 2 group by all")
def anchor_pile(spark, d):
    c = _contacts(spark, d)
    return contacts.anchor_pile(c, c.where("i = j").select("chrom", F.col("i").alias("bin")).distinct(), 2).withColumn("mean", F.round("mean", 6))


@query(f"with {_CONTACTS} select chrom, i, j, score * 2 as score from contacts")
def merge_matrices(spark, d):
    c = _contacts(spark, d)
    return contacts.merge_matrices([c, c.withColumn("score", F.col("score") * 3)])


@query(f"with {_CONTACTS} select chrom, round(corr(score, score * (j - i)), 6) as r from contacts group by chrom")
def contacts_correlate(spark, d):
    c = _contacts(spark, d)
    return contacts.correlate(c, c.withColumn("score", F.col("score") * (F.col("j") - F.col("i")))).withColumn("r", F.round("r", 6))


# --- sequences --------------------------------------------------------------------------------------


@query(f"with {DNA} select rid, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) as gc from dna")
def sequence_measures(spark, d):
    return dna(spark, d).select("rid", motifs.rc(F.col("seq")).alias("rc"), motifs.gc_content(F.col("seq")).alias("gc"))


_ARY = "len(regexp_extract_all(seq, '[AG]C[ACGT]T')) + len(regexp_extract_all(seq, 'A[ACGT]G[CT]'))"


@query(f"with {DNA} select rid, {_ARY} as n from dna")
def motif_count(spark, d):
    return dna(spark, d).select("rid", motifs.motif_count(F.col("seq"), "RCNT").cast("bigint").alias("n"))


@query(f"with {DNA} select rid, case when {_ARY} > 0 then 'Found' else 'None' end as m from dna")
def motif_flags(spark, d):
    return motifs.motif_flags(dna(spark, d), "RCNT", "m").select("rid", "m")


@query(f"with {DNA}, c as (select {_ARY} as n from dna) select cast(sum(n) as bigint) as num_motifs, cast(sum(cast(n > 0 as integer)) as bigint) as with_motif, round(sum(cast(n > 0 as integer)) * 100.0 / count(*), 6) as percent from c")
def motif_summary(spark, d):
    return motifs.motif_summary(dna(spark, d), "RCNT").withColumn("percent", F.round("percent", 6))


_POS = f"with {DNA}, p as (select rid, seq, unnest(range(0, length(seq) - 3)) as pos from dna), w as (select rid, cast(pos as integer) as pos, substr(seq, pos + 1, 4) as match from p), h as (select rid, pos, '+' as strand, match from w where regexp_full_match(match, '[AG]C[ACGT]T') union all select rid, pos, '-', match from w where regexp_full_match(match, 'A[ACGT]G[CT]')) "


@query(_POS + "select * from h")
def motif_positions(spark, d):
    return motifs.motif_positions(dna(spark, d), "RCNT", key="rid")


@query(_POS + "select pos, count(*) as count from h group by pos")
def motif_profile(spark, d):
    return motifs.position_profile(dna(spark, d), "RCNT", key="rid")


@query(f"with {DNA}, p as (select seq, unnest(range(1, length(seq) - 1)) as p from dna) select substr(seq, p, 3) as kmer, count(*) as count from p group by 1")
def kmer_freq(spark, d):
    return motifs.kmer_counts(dna(spark, d), 3)


@query(f"with {DNA}, p as (select seq, unnest(range(0, length(seq))) as pos from dna), c as (select cast(pos as integer) as pos, substr(seq, pos + 1, 1) as base, count(*) as count from p group by all), s as (select *, count / sum(count) over (partition by pos) as share from c) select pos, base, count, round(share, 6) as share, round(2 + sum(share * log2(share)) over (partition by pos), 6) as bits from s")
def base_frequencies(spark, d):
    return motifs.base_frequencies(dna(spark, d)).withColumn("share", F.round("share", 6)).withColumn("bits", F.round("bits", 6))


_PWM = motifs.counts_to_weights([[8, 1, 1, 2], [1, 9, 1, 1], [2, 2, 6, 2], [1, 1, 1, 9]])


def _pwm_sql() -> str:
    low, high = motifs.score_limits(_PWM)
    side = lambda order, flip: " + ".join(
        f"case substr(w, {i + 1}, 1) " + " ".join(f"when '{b}' then {row[3 - k] if flip else row[k]!r}" for k, b in enumerate("ACGT")) + " end" for i, row in enumerate(order)
    )
    norm = lambda s: f"(({s}) - ({low!r})) / {high - low!r}"
    return f"""with {DNA}, p as (select rid, seq, unnest(range(0, length(seq) - 3)) as pos from dna), w as (select rid, cast(pos as integer) as pos, substr(seq, pos + 1, 4) as w from p),
    s as (select rid, pos, '+' as strand, {norm(side(_PWM, False))} as score from w union all select rid, pos, '-', {norm(side(_PWM[::-1], True))} from w)
    select rid, pos, strand, round(score, 6) as score from s where score > 0.75"""


@query(_pwm_sql())
def pwm_score(spark, d):
    return motifs.pwm_hits(dna(spark, d), _PWM, key="rid").withColumn("score", F.round("score", 6))


@query(f"with {DNA} select rid, case when rid % 2 = 0 then substr(seq, 5, 11) else reverse(translate(substr(seq, 5, 11), 'ACGT', 'TGCA')) end as seq from dna")
def get_sequences(spark, d):
    s = dna(spark, d)
    chroms = s.select(F.concat(F.lit("d"), F.col("rid").cast("string")).alias("chrom"), "seq")
    at = F.struct(F.concat(F.lit("d"), F.col("rid").cast("string")).alias("chrom"), F.lit(5).cast("bigint").alias("left"), F.lit(15).cast("bigint").alias("right"))
    wanted = s.select("rid", at.alias("loc"), F.when(F.col("rid") % 2 == 0, "+").otherwise("-").alias("strand"))
    return motifs.get_sequences(wanted, motifs.sequence_chunks(chroms, 8), size=8, strand="strand").select("rid", "seq")


# --- mass spec and qPCR -----------------------------------------------------------------------------

_MS = "ms as (select concat('P', l_suppkey) as name, concat(l_returnflag, l_linestatus) as sample, avg(l_quantity) as intensity, cast(count(*) % 7 as double) as peptides from lineitem group by all)"


def _ms(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_suppkey")).alias("name"), F.concat("l_returnflag", "l_linestatus").alias("sample"), "l_quantity")
    return li.groupBy("name", "sample").agg(F.avg("l_quantity").alias("intensity"), (F.count(F.lit(1)) % 7).cast("double").alias("peptides"))


_CALL = f"""with {_MS}, c as (select name, intensity as base from ms where sample = 'AF'), t as (select m.name, sample, intensity, case when intensity + 0.1 > coalesce(base, 0) + 0.1 then log2((intensity + 0.1) / (coalesce(base, 0) + 0.1)) else -log2((coalesce(base, 0) + 0.1) / (intensity + 0.1)) end as fc
 from ms m left join c on c.name = m.name where sample in ('NO', 'RF')), u as (select name, sample, round(intensity, 6) as intensity, round(fc, 6) as fold_change, fc >= 0.05 as called from t union all select name, sample, round(intensity, 6), 0.0, null from ms where sample = 'AF')"""


@query(f"{_CALL} select * from u where name in (select name from u where called)")
def massspec_call(spark, d):
    out = massspec.call(_ms(spark, d), {"AF": ["NO", "RF"]}, threshold=0.05)
    return out.withColumn("intensity", F.round("intensity", 6)).withColumn("fold_change", F.round("fold_change", 6))


@query(f"with {_MS} select name, sample from ms where name in (select name from ms group by name having max(peptides) >= 5 and max(intensity) >= 26)")
def massspec_filter(spark, d):
    return massspec.keep_specific(_ms(spark, d), least_peptides=5, least_intensity=26).select("name", "sample")


@query(f"with {_MS} select name, case when sample in ('AF', 'RF') then 'F' else sample end as sample, round(max(intensity), 6) as intensity, max(peptides) as peptides from ms group by all")
def massspec_merge_max(spark, d):
    return massspec.merge_replicates(_ms(spark, d), {"F": ["AF", "RF"]}).withColumn("intensity", F.round("intensity", 6))


@query(f"{_CALL}, f as (select name, bool_or(sample = 'NO') as x, bool_or(sample = 'RF') as y from u where called group by name) select count(case when x and not y then 1 end) as left_only, count(case when x and y then 1 end) as overlap, count(case when y and not x then 1 end) as right_only from f")
def massspec_venn(spark, d):
    return massspec.called_venn(massspec.call(_ms(spark, d), {"AF": ["NO", "RF"]}, threshold=0.05), "NO", "RF")


@query(f"{_CALL} select distinct case sample when 'NO' then 'b1' else 'b2' end as bait, name as prey from u where called")
def massspec_edges(spark, d):
    return massspec.bait_edges(massspec.call(_ms(spark, d), {"AF": ["NO", "RF"]}, threshold=0.05), {"NO": "b1", "RF": "b2"})


@query(
    """with r as (select concat('s', l_suppkey) as sample, concat('g', l_linenumber) as primer, case when l_discount < 0.09 then 20 + l_tax * 10 else 35 end as ct from lineitem),
    t as (select sample, primer, case when stddev_pop(ct) > 5.5 then 35 else avg(ct) end as ct from r group by all) select sample, primer, round(ct, 6) as ct from t"""
)
def qpcr_table(spark, d):
    li = table(spark, d, "lineitem")
    r = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("sample"), F.concat(F.lit("g"), F.col("l_linenumber")).alias("primer"), (20 + F.col("l_tax") * 10).alias("ct"), (F.col("l_discount") < 0.09).alias("ok"))
    t = massspec.qpcr_table(r)
    return t.select("sample", "primer", F.round(F.when(F.col("std") > 5.5, 35.0).otherwise(F.col("mean")), 6).alias("ct"))


@query(
    """with r as (select concat('s', l_suppkey) as sample, concat('g', l_linenumber) as primer, 20 + l_tax * 10 as ct from lineitem), t as (select sample, primer, case when stddev_pop(ct) > 2 then 35 else avg(ct) end as ct from r group by all),
    c as (select sample, avg(ct) as c from t where primer in ('g1', 'g2') group by sample having max(ct) < 35) select sample, primer, round(20 + c - ct, 6) as value from t join c using (sample)"""
)
def qpcr_normalise(spark, d):
    li = table(spark, d, "lineitem")
    r = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("sample"), F.concat(F.lit("g"), F.col("l_linenumber")).alias("primer"), (20 + F.col("l_tax") * 10).alias("ct"), F.lit(True).alias("ok"))
    return massspec.qpcr_normalise(r, ["g1", "g2"]).withColumn("value", F.round("value", 6))


# --- learning ---------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("conditions"))


@query()
def pca_scores(spark, d):
    out, _, _ = learn.pca(_vectors(spark, d), 3)
    return out.select("rid", F.transform("scores", lambda x: F.round(F.abs(x), 4)).alias("scores"))


@query()
def kmeans_clusters(spark, d):
    return learn.kmeans(_vectors(spark, d), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query()
def bisecting_clusters(spark, d):
    return learn.bisecting(_vectors(spark, d), 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query()
def som_nodes(spark, d):
    return learn.som(_vectors(spark, d), "rid", 3, 3, epochs=4)[0]


@query()
def condition_tree(spark, d):
    order, _, groups = learn.column_tree(matrix(spark, d), NAMES, clusters=2)
    return spark.createDataFrame([(k, i, int(g)) for i, (k, g) in enumerate(zip(order, groups))], "cond string, place int, cluster int")


@query(
    f"""with {LONG}, g as (select x.cond as a, y.cond as b, sqrt(sum((x.value - y.value) * (x.value - y.value))) as d from long x join long y on x.rid = y.rid and x.cond < y.cond group by all)
    select min_by(a, d) as a, min_by(b, d) as b, round(min(d), 4) as height from g"""
)
def condition_tree_first(spark, d):
    """The first merge of the tree: the closest two conditions."""
    order, merges, _ = learn.column_tree(matrix(spark, d), NAMES)
    a, b = sorted(NAMES[int(i)] for i in merges[0, :2])
    return spark.createDataFrame([(a, b, round(float(merges[0, 2]), 4))], "a string, b string, height double")


# --- streaming forms, on a finished input -----------------------------------------------------------


@query("select date_trunc('hour', ts) as start, event_type, count(*) as count, round(sum(value), 4) as total from events group by all")
def stream_windowed_counts(spark, d):
    return streaming.windowed_counts(table(spark, d, "events"), "ts", ["event_type"]).withColumn("total", F.round("total", 4))


@query(
    """with s as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as n from events),
    g as (select *, sum(n) over (partition by user_id order by ts) as k from s) select min(ts) as start, max(ts) + interval 30 minutes as "end", user_id, count(*) as count from g group by user_id, k"""
)
def stream_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events"), "ts", ["user_id"])


@query(f"with {GENES} select event_id, gid from events join genes on chrom = concat('chr', user_id % 5) and lo <= event_id * 97 % 1000000 and hi >= event_id * 97 % 1000000")
def stream_interval_join(spark, d):
    at = (F.col("event_id") * 97) % 1000000
    place = F.struct(F.concat(F.lit("chr"), F.col("user_id") % 5).alias("chrom"), at.alias("left"), at.alias("right"))
    return streaming.interval_join(table(spark, d, "events"), genes(spark, d), place, F.col("loc")).select("a.event_id", "b.gid")




# --- further operators ------------------------------------------------------------------------------


@query(f"with {MATRIX} select rid, AF + AO as b0, NF + NO as b1, RF + RO as b2, (AF + AO) / 2 as m0, NO > 2 * AF as up from m")
def array_bins(spark, d):
    m = matrix(spark, d)
    s, a = arrays.bin_sums(F.col("conditions"), 2), arrays.bin_means(F.col("conditions"), 2)
    two = F.array(F.col("conditions")[0], F.col("conditions")[3])
    return m.select("rid", s[0].alias("b0"), s[1].alias("b1"), s[2].alias("b2"), a[0].alias("m0"), arrays.fold_up(two, ["AF", "NO"], "AF").alias("up"))


_BLOCKS = f"""{PEAKS}, {READS}, {_SWEEP}, w0 as (select *, (lo + hi) // 2 - 400 as l, (lo + hi) // 2 + 400 as r from peaks),
    x0 as (select *, max(r) over (partition by chrom order by l, r, rid rows between unbounded preceding and 1 preceding) as reach from w0),
    y0 as (select *, sum(case when reach is null or l > reach then 1 else 0 end) over (partition by chrom order by l, r, rid rows unbounded preceding) as n from x0),
    blocks as (select chrom, (min(l) + max(r)) >> 1 as mid, cast(""" + " + ".join(f"max(case when list = '{p}' then {1 << (4 - i)} else 0 end)" for i, p in enumerate(PRIORITIES)) + """ as bigint) as cid from y0 group by chrom, n),
    sizes as (select cid, count(*) as n from blocks group by cid)"""


def _blocks(spark, d):
    ix = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("list")) - 1
    return intervals.cluster_blocks(peaks(spark, d).withColumn("ix", ix), "ix", 5)


@query(
    f"""with {_BLOCKS}, c as (select b.*, greatest(s, mid - 1000) as a, least(e, mid + 1000) as z, mid - 1000 as w0, value from blocks b join track t on t.chrom = b.chrom and t.e > mid - 1000 and t.s < mid + 1000),
    k as (select cid, a - w0 as a, z - w0 as z, value, unnest(range((a - w0) // 100, (z - w0 - 1) // 100 + 1)) as bin from c)
    select k.cid, bin, round(sum(value * (least(z, (bin + 1) * 100) - greatest(a, bin * 100))) / any_value(n), 6) as mean from k join sizes using (cid) where bin < 20 group by k.cid, bin"""
)
def cluster_heat(spark, d):
    return tracks.cluster_heat(_track(spark, d), _blocks(spark, d)).withColumn("mean", F.round("mean", 6))


@query(
    f"""with {_BLOCKS}, c as (select b.cid, value, unnest(range(greatest(s, mid - 50) - mid, least(e, mid + 50) - mid)) as "offset" from blocks b join track t on t.chrom = b.chrom and t.e > mid - 50 and t.s < mid + 50)
    select c.cid, "offset", round(sum(value) / any_value(n), 6) as value from c join sizes using (cid) group by c.cid, "offset" """
)
def cluster_pileup(spark, d):
    return tracks.cluster_pileup(_track(spark, d), _blocks(spark, d), window=50).withColumn("value", F.round("value", 6))


@query("select l_linenumber, count(*) as count, round(avg(l_quantity / 10), 6) as mean, round(stddev_samp(l_quantity / 10), 6) as std from lineitem group by 1")
def scaled_spread(spark, d):
    out = stats.scaled_spread(table(spark, d, "lineitem"), "l_quantity", ["l_linenumber"], 10)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("with p as (select n_nationkey as k, (n_nationkey * 37 % 101) / 100.0 as p from nation), r as (select *, row_number() over (order by p, k) as r, count(*) over () as n from p), q as (select k, least(min(p * n / r) over (order by r desc rows unbounded preceding), 1.0) as q from r) select k, round(q, 6) as q from q")
def adjusted_p(spark, d):
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 37 % 101) / 100.0).alias("p"))
    return stats.adjust(p, "p", "k").select("k", F.round("q", 6).alias("q"))


def _dna_reads(spark, d):
    return dna(spark, d).select("rid", "seq", F.transform(F.split("seq", "(?!$)"), lambda c: F.ascii(c) - 33).alias("qual"))


@query(f"with {DNA}, p as (select seq, unnest(range(0, length(seq))) as pos from dna) select cast(pos as integer) as pos, round(avg(ascii(substr(seq, pos + 1, 1)) - 33), 6) as mean, count(*) as reads from p group by pos")
def read_quality(spark, d):
    from loomspan.operators import readqc

    return readqc.quality_by_position(_dna_reads(spark, d)).select("pos", F.round("mean", 6).alias("mean"), "reads")


@query("with n as (select text as seq, count(*) as n from documents where text is not null group by text) select least(n, 499) as copies, count(*) as sequences from n group by 1")
def read_duplicates(spark, d):
    from loomspan.operators import readqc

    return readqc.duplicates(table(spark, d, "documents").select(F.col("text").alias("seq")).where("seq is not null"))


@query()
def heat_payload(spark, d):
    return learn.heat_payload(matrix(spark, d), "rid", NAMES, row_norm=True).withColumn("value", F.round("value", 6))


_SCAN = [[1.0, 0.0, 0.0, -1.0], [0.0, 2.0, -1.0, 0.0], [-1.0, 0.0, 1.5, 0.0]]
_WINDOWS = f"""{DNA}, w as (select rid, unnest(range(0, length(seq) - 2)) as pos, seq from dna), s as (select rid, pos, substr(seq, pos + 1, 3) as k from w),
 f as (select rid, pos, '+' as strand, k, """ + " + ".join("(case substr(k, %d, 1) when 'A' then %s when 'C' then %s when 'G' then %s else %s end)" % (i + 1, *r) for i, r in enumerate(_SCAN)) + """ as v from s
 union all select rid, pos, '-', k, """ + " + ".join("(case substr(k, %d, 1) when 'T' then %s when 'G' then %s when 'C' then %s else %s end)" % (3 - i, *r) for i, r in enumerate(_SCAN)) + """ from s),
 n as (select rid, pos, strand, (v - -3.0) / (4.5 - -3.0) as score from f)"""


@query(f"with {_WINDOWS} select rid, round(max(score), 6) as score from n group by rid")
def motif_best_score(spark, d):
    return motifs.best_score(dna(spark, d), _SCAN, key="rid").select("rid", F.round("score", 6).alias("score"))


@query(f"with {_WINDOWS}, m as (select rid, avg(score) as m, stddev_pop(score) as s from n group by rid) select 'x' as motif, n.rid, cast(pos as integer) as pos, strand, round(score, 6) as score from n join m using (rid) where (score - m) / s > 1.5")
def motif_set_hits(spark, d):
    return motifs.motif_set_hits(dna(spark, d), {"x": _SCAN}, key="rid", z=1.5).select("motif", "rid", "pos", "strand", F.round("score", 6).alias("score"))


@query(f"with {_WINDOWS}, t as (select unnest(range(5)) as i) select round(0.6 + 0.1 * i, 6) as threshold, (select count(*) from n where score >= 0.6 + 0.1 * i) as hits from t")
def motif_error_rate(spark, d):
    return motifs.error_rate(dna(spark, d), _SCAN, first=0.6, step=0.1, steps=5).withColumn("threshold", F.round("threshold", 6))


@query(
    f"""with {DNA}, b as (select seq from dna union all select reverse(translate(seq, 'ACGT', 'TGCA')) from dna), p as (select unnest(range(0, (select max(length(seq)) from dna))) as pos), h as (select pos, count(*) as hits from b, p where substr(seq, pos + 1, 2) in ('AC', 'GC') group by pos),
    f as (select pos, coalesce(hits, 0) as hits from p left join h using (pos)), w as (select unnest([4, 8]) as win)
    select win as "window", x.pos, x.hits, round(sum(y.hits) / win, 6) as mean from f x, w join f y on y.pos >= x.pos and y.pos < x.pos + win join (select count(*) as places from p) as z on x.pos + win <= z.places group by win, x.pos, x.hits"""
)
def motif_periodicity(spark, d):
    return motifs.periodicity(dna(spark, d), "RC", windows=[4, 8]).withColumn("mean", F.round("mean", 6))


@query(
    f"""with {_CONTACTS}, t as (select chrom, g * 5 as lo, g * 5 + 3 as hi from (select distinct chrom, i // 5 as g from contacts))
    select t.chrom, lo * 100 as "left", hi * 100 + 99 as "right", sum(case when i between lo and hi and j between lo and hi then score else 0 end) as inside,
    sum(case when i between lo and hi and j between lo and hi then 0 else score end) as across
    from t join contacts c on c.chrom = t.chrom and (i between lo and hi or j between lo and hi) group by all"""
)
def contact_domains(spark, d):
    c = _contacts(spark, d)
    g = F.floor(F.col("i") / 5) * 5
    tads = c.select("chrom", (g * 100).alias("left"), ((g + 3) * 100 + 99).alias("right")).distinct()
    return contacts.domains(tads, c, 100)
