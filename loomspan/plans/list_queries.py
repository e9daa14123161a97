"""Queries of the row, column, set, key-join and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import loci
from loomspan.operators import intervals, keyjoin, rows, sets
from loomspan.plans.base import GENES, ORACLE, PEAKS, QUERIES, TSS, flat, genes, peaks, query
from loomspan.plans.general import table

# --- columns and rows -------------------------------------------------------------------------------


@query("select p_partkey, p_brand, p_size from part")
def select_columns(spark, d):
    return rows.select_keys(table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"])


@query("select p_partkey, p_brand as brand, p_size from part")
def rename_key(spark, d):
    return rows.rename_key(rows.select_keys(table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"]), "p_brand", "brand")


@query("select p_partkey, 'x' as tag from part")
def add_empty_key(spark, d):
    return rows.add_key(table(spark, d, "part").select("p_partkey"), "tag", "x")


@query("select p_partkey, concat('ID_', row_number() over (order by p_partkey) - 1) as label from part")
def iterable_key(spark, d):
    return rows.label_rows(table(spark, d, "part").select("p_partkey"), "label", ["p_partkey"])


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority else o_orderstatus end as k from orders")
def repair_key(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise(""))
    return rows.fill_from(o, "k", "o_orderpriority").select("o_orderkey", "k")


@query("select p_partkey, cast(p_size as varchar) as size, p_brand as brand from part")
def split_key_value(spark, d):
    packed = table(spark, d, "part").select("p_partkey", F.concat(F.lit("size:"), F.col("p_size"), F.lit(" junk brand:"), F.col("p_brand")).alias("kv"))
    return rows.split_pairs(packed, "kv", ["size", "brand"])


@query("select p_partkey, concat(p_brand, '/', p_size) as both from part")
def join_key(spark, d):
    return rows.join_keys(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "both", "{}/{}", "p_brand", "p_size")


for _op, _sql in {
    "add": "l_quantity + l_tax", "sub": "l_quantity - l_tax", "mul": "l_quantity * l_tax", "div": "case when l_discount = 0 then 0.0 else l_quantity / l_discount end", "pow": "pow(l_quantity, l_tax)",
}.items():

    def _act(spark, d, op=_op):
        other = "l_discount" if op == "div" else "l_tax"
        li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", other)
        return rows.act(li, op, "l_quantity", other, "r").select("l_orderkey", F.round("r", 6).alias("r"))

    QUERIES[f"act_{_op}"] = _act
    ORACLE[f"act_{_op}"] = f"select l_orderkey, round({_sql}, 6) as r from lineitem"


@query("select p_partkey, concat(p_brand, p_type) as r from part")
def act_cat(spark, d):
    return rows.act(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "cat", "p_brand", "p_type", "r").select("p_partkey", "r")


@query("select p_partkey, unnest(string_split(p_type, ' ')) as word from part")
def unfold(spark, d):
    return rows.unfold(table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("word")), "word")


LOCI = {
    "pointify": (loci.pointify, "(lo + hi) // 2", "(lo + hi) // 2"),
    "point_left": (loci.point_left, "lo", "lo"),
    "point_right": (loci.point_right, "hi", "hi"),
    "expand": (lambda l: loci.expand(l, 100), "lo - 100", "hi + 100"),
    "expand_left": (lambda l: loci.expand(l, 100, "left"), "lo - 100", "hi"),
    "expand_right": (lambda l: loci.expand(l, 100, "right"), "lo", "hi + 100"),
    "shrink": (lambda l: loci.shrink(l, 10), "lo + 10", "hi - 10"),
}
for _name, (_f, _lo, _hi) in LOCI.items():

    def _loc(spark, d, f=_f):
        return flat(peaks(spark, d).select("rid", f(F.col("loc")).alias("loc")))

    QUERIES[f"loc_{_name}"] = _loc
    ORACLE[f"loc_{_name}"] = f"with {PEAKS} select rid, chrom, {_lo} as lo, {_hi} as hi from peaks"


@query(f"with {PEAKS} select rid, concat(chrom, ':', lo, '-', hi) as t, hi - lo as n, (lo + hi) // 2 as m from peaks")
def loc_measures(spark, d):
    l = F.col("loc")
    return peaks(spark, d).select("rid", loci.to_text(l).alias("t"), loci.length(l).alias("n"), loci.midpoint(l).alias("m"))


@query(f"with {TSS} select gid, tss, case when strand = '+' then hi else lo end as tts from starts")
def strand_points(spark, d):
    return genes(spark, d).select("gid", F.col("tss_loc.left").alias("tss"), loci.tss(F.col("loc"), F.col("strand"), end=True)["left"].alias("tts"))


@query(
    r"""with t as (select row_id, lower(regexp_replace(loc, '[\s,\x{00A0}]', '', 'g')) as s from testc),
    u as (select row_id, regexp_extract(s, '^(chr)?([^:]+):', 2) as c, try_cast(regexp_extract(s, ':(\d+)-(\d+)$', 1) as bigint) as l, try_cast(regexp_extract(s, ':(\d+)-(\d+)$', 2) as bigint) as r from t where regexp_full_match(s, '(chr)?[^:]+:\d+-\d+'))
    select row_id, concat('chr', upper(c)) as chrom, l as lo, r as hi from u where l <= r"""
)
def loc_parse(spark, d):
    return loci.with_locus(table(spark, d, "testc").select("row_id", "loc"), "loc").where("chrom is not null").select("row_id", "chrom", F.col("left").alias("lo"), F.col("right").alias("hi"))


# --- filters and lookups ----------------------------------------------------------------------------


@query("select o_orderkey from orders where o_orderstatus = 'F'")
def get_greedy(spark, d):
    return rows.get(table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'F' order by o_orderkey limit 1")
def get_lazy(spark, d):
    return rows.get(table(spark, d, "orders"), "o_orderstatus", "F", ["o_orderkey"]).select("o_orderkey")


@query("select min(o_orderkey) as index from orders where o_orderpriority = '5-LOW'")
def index_of(spark, d):
    return rows.index_of(table(spark, d, "orders"), "o_orderpriority", "5-LOW", "o_orderkey")


@query("select p_partkey, p_brand from part where p_name = 'Brand#11' or p_brand = 'Brand#11' or p_type = 'Brand#11' order by p_partkey limit 1")
def find_any(spark, d):
    return rows.find_any(table(spark, d, "part"), "Brand#11", ["p_partkey"], ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_brand")


@query("select p_partkey from part where regexp_matches(p_brand, '1$') union all select p_partkey from part where regexp_matches(p_brand, '#[12]')")
def rows_by_regex(spark, d):
    return rows.rows_by_pattern(table(spark, d, "part"), ["1$", "#[12]"], "p_brand").select("p_partkey")


@query("select p_partkey from part where lower(p_brand) = 'brand#12'")
def rows_by_value(spark, d):
    return rows.rows_by_pattern(table(spark, d, "part"), ["brand#12"], "p_brand", use_re=False, case_sensitive=False).select("p_partkey")


@query("select o_orderkey from orders where not contains(o_orderpriority, 'LOW')")
def filter_in(spark, d):
    return rows.filter_in(table(spark, d, "orders"), "o_orderpriority", "LOW").select("o_orderkey")


@query("select o_orderkey from orders where o_totalprice > 200000")
def filter_value(spark, d):
    return rows.filter_value(table(spark, d, "orders"), "o_totalprice", "gt", 200000).select("o_orderkey")


@query("select p_partkey from part where p_size between 0 and 10")
def values_in_range(spark, d):
    return rows.values_in_range(table(spark, d, "part"), "p_size", 0, 10).select("p_partkey")


@query(f"with {PEAKS} select rid from peaks where chrom in ('chr1', 'chr2', 'chr3', 'chr4')")
def canonical_chroms(spark, d):
    return rows.keep_chromosomes(peaks(spark, d), F.col("loc.chrom")).select("rid")


@query("select l_orderkey, l_discount from lineitem where l_discount <> 0")
def remove_empty(spark, d):
    return rows.remove_empty(table(spark, d, "lineitem"), "l_discount").select("l_orderkey", "l_discount")


@query("select o_orderkey from orders where o_orderstatus <> 'F'")
def remove(spark, d):
    return rows.remove(table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey")


# --- distinct, order, counts ------------------------------------------------------------------------


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def remove_duplicates(spark, d):
    return rows.distinct_on(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by all")
def remove_duplicates_composite(spark, d):
    return rows.distinct_on(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def exact_duplicates(spark, d):
    return rows.exact_distinct(table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders")
def sort_key(spark, d):
    return rows.with_ordinal(table(spark, d, "orders"), "place", ["o_totalprice", "o_orderkey"]).select("o_orderkey", "place")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey desc) - 1 as place from orders")
def sort_reverse(spark, d):
    return rows.with_ordinal(table(spark, d, "orders"), "place", [F.desc("o_totalprice"), F.desc("o_orderkey")]).select("o_orderkey", "place")


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_orderstatus, o_orderkey) - 1 as place from orders")
def multi_sort(spark, d):
    return rows.with_ordinal(table(spark, d, "orders"), "place", ["o_orderpriority", "o_orderstatus", "o_orderkey"]).select("o_orderkey", "place")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey desc limit 30")
def top_k(spark, d):
    return rows.top_k(table(spark, d, "part"), ["p_retailprice"], 30, ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("select p_partkey from part order by p_partkey limit 20 offset 10")
def slice_rows(spark, d):
    return rows.slice_rows(table(spark, d, "part"), 10, 30, ["p_partkey"]).select("p_partkey")


@query()
def sample_rows(spark, d):
    return rows.sample(table(spark, d, "orders"), 50, 7, ["o_orderkey"]).select("o_orderkey")


@query()
def shuffle_rows(spark, d):
    return rows.shuffle(table(spark, d, "part"), 7, ["p_partkey"]).select("p_partkey")


@query("select o_orderpriority, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from orders group by o_orderpriority")
def value_counts(spark, d):
    return rows.value_counts(table(spark, d, "orders"), "o_orderpriority", percents=True).withColumn("percent", F.round("percent", 6))


@query(
    """with a as (select p_brand, count(*) as n from part where p_size <= 10 group by 1), e as (select p_size, p_brand, count(*) as n from part where p_size > 10 group by all),
    k as (select count(distinct p_size) as k from part where p_size > 10),
    s as (select p_brand, sum(n) / k as mean, sqrt(greatest(sum(n * n) / k - (sum(n) / k) * (sum(n) / k), 0)) as std from e, k group by p_brand, k)
    select coalesce(a.p_brand, s.p_brand) as p_brand, coalesce(n, 0) as count, round(coalesce(mean, 0), 6) as mean, round(coalesce(std, 0), 5) as std from a full join s on a.p_brand = s.p_brand"""
)
def freq_background(spark, d):
    p = table(spark, d, "part")
    out = rows.frequency_background(p.where("p_size <= 10"), p.where("p_size > 10"), "p_brand", "p_size")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 5))


@query("select cast(least(floor(o_totalprice / 10000), 49) as integer) as bin, count(*) as count from orders where o_totalprice between 0 and 500000 group by 1")
def histogram(spark, d):
    return rows.histogram(table(spark, d, "orders"), "o_totalprice", 0, 500000, 50)


@query(
    """select p_partkey, case when p_retailprice / 1000 > 1.2 and p_size > 25 then 'up' when p_retailprice / 1000 < -1.2 and p_size > 25 then 'down' else 'none' end as change from part"""
)
def volcano(spark, d):
    p = table(spark, d, "part").withColumn("fc", F.col("p_retailprice") / 1000)
    return rows.volcano(p, "p_size", "fc", q_threshold=25, fc_threshold=1.2, log_q=False).select("p_partkey", "change")


@query("select p_partkey, case when n = 0 then p_name else concat(p_name, '_', n) end as p_name from (select *, row_number() over (partition by p_name order by p_partkey) - 1 as n from part)")
def make_unique(spark, d):
    return rows.make_unique(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])


# --- sets -------------------------------------------------------------------------------------------


def _two(spark, d):
    li = table(spark, d, "lineitem")
    return [li.select("l_suppkey", "l_linenumber"), li.select(F.col("l_partkey").alias("l_suppkey"), "l_linenumber")]


_TWO = "a as (select l_suppkey, l_linenumber from lineitem), b as (select l_partkey as l_suppkey, l_linenumber from lineitem)"


@query(f"with {_TWO} select * from a union all select * from b")
def set_add(spark, d):
    return sets.add(*_two(spark, d))


@query(f"with {_TWO} select * from a union select * from b")
def set_or(spark, d):
    return sets.union(*_two(spark, d))


@query("with a as (select distinct l_suppkey, l_linenumber from lineitem), b as (select l_partkey as l_suppkey, l_linenumber from lineitem) select a.* from a join b using (l_suppkey, l_linenumber)")
def set_and(spark, d):
    a, b = _two(spark, d)
    return sets.intersect(a.distinct(), b)


@query("select c_custkey as k from customer where c_custkey not in (select o_custkey from orders)")
def set_sub(spark, d):
    return sets.subtract(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_MASKS = "mk as (select o_custkey, " + " | ".join(f"max(case when o_orderpriority = '{p}' then {1 << i} else 0 end)" for i, p in enumerate(PRIORITIES)) + " as mask from orders group by 1)"


@query(f"with {_MASKS} select cast(mask as bigint) as mask, count(*) as count from mk where mask > 0 group by 1")
def venn_mask(spark, d):
    return sets.venn(table(spark, d, "orders"), "o_orderpriority", "o_custkey", PRIORITIES)


_SHARED = """l as (select distinct o_orderpriority as p, o_custkey as k from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')), n as (select p, count(*) as n from l group by p),
 h as (select x.p as a, y.p as b, count(case when z.k is not null then 1 end) as hits from n x join n y on x.p < y.p join l q on q.p = x.p left join l z on z.p = y.p and z.k = q.k group by all)"""


@query(f"with {_SHARED} select a, b, hits, round(greatest(hits, 1) / least(x.n, y.n), 6) as score from h join n x on x.p = a join n y on y.p = b")
def venn_pairwise(spark, d):
    return sets.pairwise(table(spark, d, "orders"), "o_orderpriority", "o_custkey", PRIORITIES).withColumn("score", F.round("score", 6))


@query(f"with {_SHARED} select a, b, hits, round(greatest(hits, 1) / (x.n + y.n - greatest(hits, 1)), 6) as score from h join n x on x.p = a join n y on y.p = b")
def jaccard_compare(spark, d):
    return sets.pairwise(table(spark, d, "orders"), "o_orderpriority", "o_custkey", PRIORITIES, jaccard=True).withColumn("score", F.round("score", 6))


@query(
    f"""with {PEAKS}, n as (select list, count(*) as n from peaks group by 1), b as (select distinct list, chrom, lo // 2000 as bin from peaks),
    h as (select x.list as a, y.list as b, count(*) as hits from b x join b y on x.chrom = y.chrom and x.bin = y.bin and x.list < y.list group by all)
    select p.list as a, q.list as b, round((coalesce(hits, 0) + 1) / least(p.n, q.n), 6) as score from n p join n q on p.list < q.list left join h on h.a = p.list and h.b = q.list"""
)
def compare_bins(spark, d):
    p = peaks(spark, d).select("list", F.col("loc.chrom").alias("chrom"), F.col("loc.left").alias("left"))
    return sets.compare_bins(p, "list", "chrom", "left").withColumn("score", F.round("score", 6))


@query(
    f"""with {PEAKS} select chrom, lo // 1000 * 1000 as block, """
    + ", ".join(f"coalesce(max(case when list = '{p}' then 1 end), 0) as p{i}" for i, p in enumerate(PRIORITIES))
    + ", count(distinct list) as members from peaks where list in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') group by all"
)
def overlap_grid(spark, d):
    p = peaks(spark, d).select("list", F.col("loc.chrom").alias("chrom"), F.col("loc.left").alias("left"))
    out = sets.occupancy(p, "list", "chrom", "left", PRIORITIES)
    return out.withColumnsRenamed({p: f"p{i}" for i, p in enumerate(PRIORITIES)}).withColumn("members", F.col("members").cast("bigint"))


@query(
    """with t as (select o_orderpriority as list, o_custkey as term, 1.0 / (1 + o_totalprice) as p from orders), r as (select *, row_number() over (partition by list order by p, term) as k from t),
    b as (select distinct term from r where k <= 5), l as (select distinct list from t), v as (select list, term, min(p) as p from t group by all)
    select b.term, l.list, round(coalesce(-log10(v.p + 1e-300), 0), 6) as value from b cross join l left join v on v.list = l.list and v.term = b.term"""
)
def top_terms(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("list"), F.col("o_custkey").alias("term"), (1.0 / (1 + F.col("o_totalprice"))).alias("p"))
    return sets.top_terms(t, "list", "term", "p").withColumn("value", F.round("value", 6))


@query("select concat_ws(chr(9), n_regionkey, n_regionkey, string_agg(n_name, chr(9) order by n_name)) as value from nation group by n_regionkey")
def gmt_lines(spark, d):
    return sets.gmt_lines(table(spark, d, "nation"), "n_regionkey", "n_name")


# --- key joins --------------------------------------------------------------------------------------


def _keyed(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("v"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("v"))
    return c, o


@query("select o_custkey as k, o_orderkey as o, o_totalprice as v, c_mktsegment as segment from orders join customer on c_custkey = o_custkey")
def map_inner(spark, d):
    return keyjoin.map_join(*_keyed(spark, d), "k")


@query("with f as (select o_custkey, min(o_orderkey) as o, min_by(o_totalprice, o_orderkey) as v from orders group by 1) select c_custkey as k, c_mktsegment as segment, c_acctbal as v, o from customer join f on o_custkey = c_custkey")
def map_lazy(spark, d):
    c, o = _keyed(spark, d)
    return keyjoin.map_join(o, c, "k", greedy=False, order=["o"])


@query("select c_custkey as k, c_mktsegment as segment, c_acctbal as v from customer where c_custkey not in (select o_custkey from orders)")
def map_notright(spark, d):
    c, o = _keyed(spark, d)
    return keyjoin.map_join(o, c, "k", logic="notright")


@query("select s_suppkey as k, s_acctbal as v0, c_acctbal as v1 from supplier join customer on s_suppkey = c_custkey")
def merge_tables(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.array("s_acctbal").alias("conditions"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array("c_acctbal").alias("conditions"))
    return keyjoin.merge_tables([a, b], "k").select("k", F.col("conditions")[0].alias("v0"), F.col("conditions")[1].alias("v1"))


@query("select c_custkey, cast(c_custkey in (select o_custkey from orders) as double) as hit from customer")
def hits_along(spark, d):
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return keyjoin.hits_along(table(spark, d, "customer").select("c_custkey"), members, "c_custkey")


# --- interval joins ---------------------------------------------------------------------------------

_PG = f"with {PEAKS}, {GENES}"
_HIT = {
    "collide": (200, lambda n: f"((p.lo + p.hi) // 2 - {n} <= (g.lo + g.hi) // 2 + {n} and (p.lo + p.hi) // 2 + {n} >= (g.lo + g.hi) // 2 - {n})"),
    "overlap": (0, lambda n: f"(p.hi + {n} >= g.lo - {n} and p.lo - {n} <= g.hi + {n})"),
}


def _named(spark, d):
    g = genes(spark, d).select(F.col("gid").alias("rid"), "loc")
    return peaks(spark, d).select("rid", "loc"), g


for _mode, (_delta, _test) in _HIT.items():
    for _logic in ("and", "notinleft", "notinright", "not"):

        def _meet(spark, d, mode=_mode, logic=_logic):
            p, g = _named(spark, d)
            out = getattr(intervals, mode)(p, g, logic=logic)
            return flat(out)

        QUERIES[f"{_mode}_{_logic}"] = _meet
        _on = f"p.chrom = g.chrom and {_test(_delta)}"
        _mid = lambda t: f"({t}.lo + {t}.hi) // 2"
        if _mode == "collide":
            _l, _r = f"(({_mid('p')}) - 200 + ({_mid('g')}) - 200)", f"(({_mid('p')}) + 200 + ({_mid('g')}) + 200)"
        else:
            _l, _r = "(p.lo + g.lo)", "(p.hi + g.hi)"
        _half = lambda x: f"cast(trunc({x} / 2) as bigint)"
        _m = f"(({_half(_l)} + {_half(_r)}) >> 1)"
        _anti = {
            "notinleft": f"select g.gid as rid, g.chrom, {_mid('g')} as lo, {_mid('g')} as hi from genes g where not exists (select 1 from peaks p where {_on})",
            "notinright": f"select p.rid, p.chrom, {_mid('p')} as lo, {_mid('p')} as hi from peaks p where not exists (select 1 from genes g where {_on})",
        }
        ORACLE[f"{_mode}_{_logic}"] = f"{_PG} " + (
            f"select g.gid as rid, g.chrom, {_m} - {_delta} as lo, {_m} + {_delta} as hi, {_mid('p')} - {_mid('g')} as dist from peaks p join genes g on {_on}"
            if _logic == "and"
            else f"{_anti['notinleft']} union all {_anti['notinright']}"
            if _logic == "not"
            else _anti[_logic]
        )


@query(f"{_PG} select p.rid as rank_a, g.gid as rank_b, p.lo as first_lo, g.lo as own_lo from peaks p join genes g on p.chrom = g.chrom and {_HIT['overlap'][1](100)}")
def overlap_merge_keys(spark, d):
    p, g = _named(spark, d)
    p = p.withColumn("first_lo", F.col("loc.left"))
    out = intervals.overlap(p, g, delta=100, keep_rank=True, merge_keys=True, keep_loc=True)
    return out.select("rank_a", "rank_b", "first_lo", F.col("original_loc.left").alias("own_lo"))


@query(f"{_PG} select gid as rid, exists (select 1 from peaks p where p.chrom = g.chrom and {_HIT['collide'][1](50)}) as found from genes g")
def in_list(spark, d):
    p, g = _named(spark, d)
    return intervals.in_list(g, p, delta=50).select("rid", "found")


@query(f"with {PEAKS} select rid from peaks where chrom = 'chr1' and hi >= 100000 and lo <= 200000")
def features_overlapping(spark, d):
    return intervals.features_in(peaks(spark, d), "chr1", 100000, 200000).select("rid")


_NEAR = f"""with {PEAKS}, {TSS}, h as (select p.rid, g.gid, case when strand = '+' then (p.lo + p.hi) // 2 - tss else tss - (p.lo + p.hi) // 2 end as dist_to_tss
 from peaks p join starts g on p.chrom = g.chrom and abs((p.lo + p.hi) // 2 - tss) <= """


@query(f"{_NEAR} 2000) select * from h")
def annotate_within(spark, d):
    return intervals.annotate(genes(spark, d), peaks(spark, d), distance_bp=2000).select("rid", "gid", "dist_to_tss")


_CLOSEST = "c as (select rid, arg_min(gid, row(abs(dist_to_tss), gid)) as gid, arg_min(dist_to_tss, row(abs(dist_to_tss), gid)) as dist_to_tss from h group by rid)"


@query(f"{_NEAR} 10000), {_CLOSEST} select * from c")
def annotate_closest(spark, d):
    return intervals.annotate(genes(spark, d), peaks(spark, d), closest_only=True).select("rid", "gid", "dist_to_tss")


_BAND = "case " + " ".join(f"when dist_to_tss / 1000 >= {a} and dist_to_tss / 1000 < {b} then '{a} to {b}'" for a, b in intervals.BANDS) + " end"


@query(
    f"""{_NEAR} 200000), {_CLOSEST}, b as (select {_BAND} as band, count(*) as count from c where {_BAND} is not null group by 1 union all select 'desert', (select count(*) from peaks) - (select count(*) from c))
    select band, count, round(count * 100.0 / sum(count) over (), 6) as percent from b"""
)
def distribution_bands(spark, d):
    return intervals.distribution(genes(spark, d), peaks(spark, d)).withColumn("percent", F.round("percent", 6))


@query(
    f"""with {PEAKS}, {TSS}, m as (select gid, min(abs((p.lo + p.hi) // 2 - tss)) as d from starts g join peaks p on p.chrom = g.chrom and abs((p.lo + p.hi) // 2 - tss) <= 400 group by gid)
    select w.w as within, round(count(*) * 100.0 / (select count(*) from customer), 6) as percent from m join (select unnest([100, 200, 300, 400]) as w) w on d < w.w group by all"""
)
def cumulative_annotation(spark, d):
    return intervals.cumulative_annotation(genes(spark, d), peaks(spark, d), [100, 200, 300, 400]).withColumn("percent", F.round("percent", 6))


@query(
    f"""with {PEAKS}, {TSS}, h as (select gid, case when strand = '-' then tss - (p.lo + p.hi) // 2 else (p.lo + p.hi) // 2 - tss end as d from starts g join peaks p on p.chrom = g.chrom)
    select gid as gene, cast(floor((d + 1000) / 100) as integer) as bin, count(*) as count from h where d >= -1000 and d < 1000 group by all"""
)
def tags_to_tss(spark, d):
    return intervals.tags_to_tss(peaks(spark, d), genes(spark, d), -1000, 1000, 100)


@query(f"with {PEAKS} select rid from peaks p where not exists (select 1 from peaks g where g.rid <> p.rid and g.chrom = p.chrom and p.hi >= g.lo and p.lo <= g.hi)")
def dedupe_delete_any(spark, d):
    return intervals.dedupe_by_loc(peaks(spark, d), mode="overlap", delete_any_matches=True).select("rid")


@query(
    f"""with recursive {PEAKS}, w as (select rid, chrom, (lo + hi) // 2 - 200 as l, (lo + hi) // 2 + 200 as r from peaks),
    x as (select *, max(r) over (partition by chrom order by l, r, rid rows between unbounded preceding and 1 preceding) as reach from w),
    y as (select *, sum(case when reach is null or l > reach then 1 else 0 end) over (partition by chrom order by l, r, rid rows unbounded preceding) as island from x),
    k as (select *, row_number() over (partition by chrom, island order by rid) as n, count(*) over (partition by chrom, island) as size from y),
    g as (select chrom, island, 1::bigint as n, size, [{{'id': rid, 'l': l, 'r': r}}] as kept from k where n = 1
      union all select g.chrom, g.island, k.n, g.size, case when len(list_filter(g.kept, lambda e: e.l <= k.r and e.r >= k.l)) = 0 then list_append(g.kept, {{'id': k.rid, 'l': k.l, 'r': k.r}}) else g.kept end from g join k on k.chrom = g.chrom and k.island = g.island and k.n = g.n + 1)
    select unnest(kept).id as rid from g where n = size"""
)
def dedupe_by_loc(spark, d):
    return intervals.dedupe_by_loc(peaks(spark, d)).select("rid")


@query(
    f"""with {PEAKS}, w as (select *, (lo + hi) // 2 - 400 as l, (lo + hi) // 2 + 400 as r from peaks),
    x as (select *, max(r) over (partition by chrom order by l, r, rid rows between unbounded preceding and 1 preceding) as reach from w),
    y as (select *, sum(case when reach is null or l > reach then 1 else 0 end) over (partition by chrom order by l, r, rid rows unbounded preceding) as n from x)
    select chrom, min(l) as lo, max(r) as hi, cast("""
    + " + ".join(f"max(case when list = '{p}' then {1 << (4 - i)} else 0 end)" for i, p in enumerate(PRIORITIES))
    + " as bigint) as cid from y group by chrom, n"
)
def cluster_blocks(spark, d):
    ix = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("list")) - 1
    out = intervals.cluster_blocks(peaks(spark, d).withColumn("ix", ix), "ix", 5)
    return out.select("chrom", F.col("left").alias("lo"), F.col("right").alias("hi"), "cid")


@query(
    f"""with recursive {PEAKS}, k as (select *, row_number() over (partition by chrom order by hi, hi - lo, rid) as n from peaks),
    g as (select chrom, rid, hi, n from k where n = 1
      union all select chrom, f.rid, f.hi, f.n from (select g.chrom, min_by({{'rid': k.rid, 'hi': k.hi, 'n': k.n}}, k.n) as f from g join k on k.chrom = g.chrom and k.n > g.n and k.lo > g.hi group by g.chrom))
    select rid from g"""
)
def most_disjoint(spark, d):
    return intervals.most_disjoint(peaks(spark, d)).select("rid")
