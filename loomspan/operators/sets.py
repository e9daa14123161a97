"""Set operations on lists, and comparisons of many named lists."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(lists: dict[str, DataFrame], name: str = "list_name") -> DataFrame:
    """Named lists in one frame with ``name``, the order of the arguments as ``list_ix``; keys a list lacks are null."""
    if not lists:
        raise ValueError("no lists")
    named = [df.withColumn(name, F.lit(n)).withColumn("list_ix", F.lit(i)) for i, (n, df) in enumerate(lists.items())]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def shared_keys(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def compatible(a: DataFrame, b: DataFrame) -> bool:
    return bool(shared_keys(a, b))


def _need_shared(a: DataFrame, b: DataFrame) -> list[str]:
    keys = shared_keys(a, b)
    if not keys:
        raise ValueError("the lists share no key")
    return keys


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; keys only one has are null in the other's rows."""
    _need_shared(a, b)
    return a.unionByName(b, allowMissingColumns=True)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return add(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` once for every row of ``b`` that equals them in all shared keys (null equals null)."""
    keys = _need_shared(a, b)
    times = b.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_times"))
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    out = a.join(times, same).withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return out.select(*a.columns)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that equal no row of ``b`` in all shared keys."""
    keys = _need_shared(a, b)
    other = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct()
    return a.join(other, functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]), "left_anti")


def membership(rows: DataFrame, list_col: str, key: str, lists: list[str]) -> DataFrame:
    """``key, mask``: bit i is set if the key is in ``lists[i]``; other lists don't count."""
    bits = F.create_map(*[x for i, name in enumerate(lists) for x in (F.lit(name), F.lit(1 << i).cast("bigint"))])
    wanted = rows.where(F.col(list_col).isin(*lists) & F.col(key).isNotNull())
    return wanted.groupBy(key).agg(F.bit_or(F.element_at(bits, F.col(list_col))).alias("mask"))


def venn(rows: DataFrame, list_col: str, key: str, lists: list[str]) -> DataFrame:
    """``mask, count``: distinct keys in exactly the lists of each combination."""
    return membership(rows, list_col, key, lists).groupBy("mask").agg(F.count(F.lit(1)).alias("count"))


def pairwise(rows: DataFrame, list_col: str, key: str, lists: list[str], *, jaccard: bool = False) -> DataFrame:
    """``a, b, hits, score`` of every pair of named lists: shared keys over the smaller list, or Jaccard; no hits count as 1.

    The pairs are counted in one pass over the membership masks; over 63 lists, over the different sets of lists that keys are in.
    """
    if len(lists) > 63:
        return _pairs_of_many(rows, list_col, key, lists, jaccard)
    masks = venn(rows, list_col, key, lists)  # at most min(keys, 2**lists) rows
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
    hit = lambda t: F.coalesce(F.sum(F.when(t, F.col("count"))), F.lit(0))
    pairs = [(i, j) for i in range(len(lists)) for j in range(i + 1, len(lists))]
    made = [F.struct(F.lit(lists[i]).alias("a"), F.lit(lists[j]).alias("b"), hit(has(i) & has(j)).alias("hits"), hit(has(i)).alias("na"), hit(has(j)).alias("nb")) for i, j in pairs]
    rows = masks.agg(F.array(*made).alias("p")).select(F.inline("p"))
    return _scored(rows, jaccard)


def _scored(rows: DataFrame, jaccard: bool) -> DataFrame:
    n = F.greatest("hits", F.lit(1))
    whole = F.col("na") + F.col("nb") - n if jaccard else F.least("na", "nb")
    return rows.select("a", "b", "hits", F.try_divide(n.cast("double"), whole).alias("score"))


def _pairs_of_many(rows: DataFrame, list_col: str, key: str, lists: list[str], jaccard: bool) -> DataFrame:
    """``pairwise`` for any number of lists; keys that are in the same lists are counted first and expanded once."""
    number = {n: i for i, n in enumerate(lists)}
    named = rows.sparkSession.createDataFrame(list(number.items()), f"`{list_col}` string, _i int")
    wanted = rows.where(F.col(key).isNotNull()).join(F.broadcast(named), list_col)  # one row per list
    together = wanted.groupBy(key).agg(F.sort_array(F.collect_set("_i")).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    sizes = together.select(F.explode("l").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("size"))
    hits = together.select(F.explode(_pairs("l")).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("hits"))
    order = named.select(F.array_sort(F.collect_list("_i")).alias("l"))
    every = order.select(F.explode(_pairs("l")).alias("p")).select("p.a", "p.b")  # the result has these rows
    sized = named.join(sizes, named["_i"] == sizes["i"], "left").select("_i", F.col(list_col).alias("name"), F.coalesce("size", F.lit(0)).alias("size"))
    one, two = sized.select(F.col("_i").alias("a"), F.col("name").alias("na_"), F.col("size").alias("na")), sized.select(F.col("_i").alias("b"), F.col("name").alias("nb_"), F.col("size").alias("nb"))
    full = every.join(hits, ["a", "b"], "left").join(one, "a").join(two, "b")
    return _scored(full.select(F.col("na_").alias("a"), F.col("nb_").alias("b"), F.coalesce("hits", F.lit(0)).alias("hits"), "na", "nb"), jaccard)


def _pairs(name: str) -> Column:
    """Pairs (a, b) of the entries of an array, the earlier one first."""
    return F.flatten(F.transform(name, lambda x, i: F.transform(F.slice(name, i + 2, F.size(name)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def compare_bins(rows: DataFrame, list_col: str, chrom: str, left: str, *, bin_size: int = 2000) -> DataFrame:
    """``a, b, score``: similarity of every two lists by the bins their left ends mark: (shared bins + 1) / smaller number of rows.

    Bins that the same lists mark are counted first, and the pairs made once for each such set of lists. Null list names don't count.
    """
    sizes = rows.where(F.col(list_col).isNotNull()).groupBy(list_col).agg(F.count(F.lit(1)).alias("n"))
    marked = rows.where(F.col(list_col).isNotNull()).select(list_col, chrom, F.floor(F.col(left) / bin_size).alias("bin")).distinct()
    per_bin = marked.groupBy(chrom, "bin").agg(F.sort_array(F.collect_set(list_col)).alias("l"))
    together = per_bin.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    hits = together.select(F.explode(_pairs("l")).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("hits"))
    every = sizes.agg(F.sort_array(F.collect_list(F.struct(list_col, "n"))).alias("l")).select(F.explode(_pairs("l")).alias("p"))  # the result has these rows
    named = every.select(F.col(f"p.a.{list_col}").alias("a"), F.col(f"p.b.{list_col}").alias("b"), F.least("p.a.n", "p.b.n").alias("least"))
    return named.join(hits, ["a", "b"], "left").select("a", "b", ((F.coalesce("hits", F.lit(0)) + 1) / F.col("least")).alias("score"))


def occupancy(rows: DataFrame, list_col: str, chrom: str, left: str, lists: list[str], *, resolution: int = 1000, score: str | None = None) -> DataFrame:
    """``chrom, block, <list>..., members``: presence (or largest score) of every list in every occupied block."""
    at = (F.floor(F.col(left) / resolution) * resolution).alias("block")
    columns = [F.coalesce(F.max(F.when(F.col(list_col) == n, F.col(score) if score else F.lit(1))), F.lit(0)).alias(n) for n in lists]
    out = rows.where(F.col(list_col).isin(*lists)).groupBy(F.col(chrom).alias("chrom"), at).agg(*columns)
    return out.withColumn("members", functools.reduce(operator.add, [(F.col(n) != 0).cast("int") for n in lists]))


def top_terms(rows: DataFrame, list_col: str, term: str, p: str, *, top: int = 5, limit: float = 0.01) -> DataFrame:
    """``term, list, value``: -log10 p of every term that is among any list's ``top`` below ``limit``; absent ones are 0."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(list_col).orderBy(p, term))
    best = rows.where(F.col(p) <= limit).withColumn("_k", rank).where(F.col("_k") <= top).select(term).distinct()
    lists = rows.agg(F.collect_set(list_col)).scalar()  # one array of list names
    grid = best.withColumn("_lists", lists).withColumn(list_col, F.explode("_lists")).drop("_lists")
    values = rows.groupBy(list_col, term).agg(F.min(p).alias("_p"))
    return grid.join(values, [list_col, term], "left").select(term, list_col, F.coalesce(-F.log10(F.col("_p") + 1e-300), F.lit(0.0)).alias("value"))


def gmt_lines(rows: DataFrame, list_col: str, key: str) -> DataFrame:
    """``value``: one tab-separated line per list: its name twice, then its keys in order."""
    keys = F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\t")
    return rows.groupBy(list_col).agg(keys.alias("_keys")).select(F.concat_ws("\t", list_col, list_col, "_keys").alias("value"))
