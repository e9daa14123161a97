"""Statistics of conditions: summaries, tests, ranks, sliding windows. Data stays distributed; p-values are made from a few sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.special import chi2_upper, normal_two_sided, t_two_sided
from loomspan.operators.matrix import V, to_long
from loomspan.operators.rows import with_ordinal
from loomspan.session import checkpointed


def summary(df: DataFrame, names: list[str], *, log2: bool = False) -> DataFrame:
    """``cond, min, max, sum, mean, median, std`` (population); with ``log2`` of the non-zero values."""
    long = to_long(df, names, [])
    if log2:
        long = long.where("value <> 0").withColumn("value", F.log2("value"))
    return long.groupBy("cond").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std")
    )


def overall(df: DataFrame) -> DataFrame:
    """``min, max, mean, std`` of the whole matrix."""
    x = df.select(F.explode(V).alias("x"))
    return x.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def ttest(df: DataFrame, names: list[str], a: str, b: str, *, equal_var: bool = False) -> DataFrame:
    """``t, df`` of the independent two-sample test of two conditions."""
    x, y = F.col(V)[names.index(a)], F.col(V)[names.index(b)]
    s = df.agg(F.count(x).alias("n1"), F.avg(x).alias("m1"), F.var_samp(x).alias("v1"), F.count(y).alias("n2"), F.avg(y).alias("m2"), F.var_samp(y).alias("v2"))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    if equal_var:
        free = n1 + n2 - 2
        wide = ((n1 - 1) * v1 + (n2 - 1) * v2) / free * (1 / n1 + 1 / n2)
    else:
        wide = v1 / n1 + v2 / n2
        free = wide * wide / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))
    return s.select(F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(wide)).alias("t"), free.cast("double").alias("df"))


def ttest_p(df: DataFrame, names: list[str], a: str, b: str, *, equal_var: bool = False) -> tuple[float, float]:
    t, free = ttest(df, names, a, b, equal_var=equal_var).first()
    return t, t_two_sided(t, free)


def pearsonr(df: DataFrame, names: list[str], a: str, b: str) -> DataFrame:
    """``r, n``."""
    x, y = F.col(V)[names.index(a)], F.col(V)[names.index(b)]
    return df.agg(F.corr(x, y).alias("r"), F.count(x).alias("n"))


def correlation_p(r: float, n: int) -> float:
    return t_two_sided(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2) if n > 2 else math.nan


def average_ranks(df: DataFrame, value: Column | str, name: str, by: list[str] = ()) -> DataFrame:
    """Rank of each value, ties sharing the mean of theirs: counts per distinct value, then running counts.

    Only the distinct values are ordered, by a range-partitioned ordinal sum; rows are not windowed.
    """
    v = F.col(value) if isinstance(value, str) else value
    keyed = df.withColumn("_v", v)
    counts = keyed.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    below = running_total(counts, "_n", [*by, "_v"], list(by))
    ranks = below.select(*by, "_v", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return keyed.join(ranks, [*by, "_v"]).drop("_v")


def running_total(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Add ``_before``: sum of ``value`` over the rows before, by ``order``, within ``by`` (a prefix of it).

    Two levels: sums inside range partitions, plus the totals of earlier partitions (one row per partition and
    group), so that no group has to fit one task.
    """
    part = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))  # sampled bounds: cut once
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = part.groupBy("_p", *by).agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    return local.join(offset, ["_p", *by]).withColumn("_before", F.col("_in") + F.col("_off")).drop("_p", "_in", "_off")


def spearmanr(df: DataFrame, names: list[str], a: str, b: str) -> DataFrame:
    """``r, n`` of the ranks of two conditions."""
    x = df.select(F.col(V)[names.index(a)].alias("x"), F.col(V)[names.index(b)].alias("y"))
    ranked = average_ranks(average_ranks(x, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("r"), F.count("rx").alias("n"))


def rank_sums(df: DataFrame, names: list[str], some: list[str]) -> DataFrame:
    """``cond, n, ranks``: sums of the pooled ranks of some conditions."""
    long = to_long(df, names, []).where(F.col("cond").isin(*some)).select("cond", "value")
    return average_ranks(long, "value", "rank").groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"))


def _tie_sum(df: DataFrame, names: list[str], some: list[str]) -> DataFrame:
    long = to_long(df, names, []).where(F.col("cond").isin(*some))
    n = F.col("n").cast("double")
    return long.groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * n * n - n).alias("ties"))


def kruskal(df: DataFrame, names: list[str], some: list[str]) -> DataFrame:
    """``h``: Kruskal-Wallis statistic over conditions, corrected for ties."""
    s = rank_sums(df, names, some).agg(F.sum("n").alias("n"), F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("q"))
    n = F.col("n")
    ties = _tie_sum(df, names, some).scalar()
    raw = 12.0 / (n * (n + 1)) * F.col("q") - 3.0 * (n + 1)
    return s.select(F.try_divide(raw, 1.0 - ties / (n.cast("double") * n * n - n)).alias("h"))


def kruskal_p(df: DataFrame, names: list[str], some: list[str]) -> tuple[float, float]:
    h = kruskal(df, names, some).first()[0]
    return h, chi2_upper(h, len(some) - 1)


def mannwhitney(df: DataFrame, names: list[str], a: str, b: str) -> DataFrame:
    """``u``: Mann-Whitney statistic of the first condition; ``z`` with tie and continuity correction."""
    s = rank_sums(df, names, [a, b]).agg(
        F.max(F.when(F.col("cond") == a, F.col("n"))).alias("n1"), F.max(F.when(F.col("cond") == b, F.col("n"))).alias("n2"), F.max(F.when(F.col("cond") == a, F.col("ranks"))).alias("r1")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    wide = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - _tie_sum(df, names, [a, b]).scalar() / (n * (n - 1))))
    top = F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5
    return s.select(u.alias("u"), F.try_divide(top, wide).alias("z"))


def mannwhitney_p(df: DataFrame, names: list[str], a: str, b: str) -> tuple[float, float]:
    u, z = mannwhitney(df, names, a, b).first()
    return u, min(1.0, normal_two_sided(z))


def wilcoxon(df: DataFrame, names: list[str], a: str, b: str) -> DataFrame:
    """``w, n``: signed-rank statistic (smaller of both sums) of paired conditions, zero differences left out."""
    d = df.select((F.col(V)[names.index(a)] - F.col(V)[names.index(b)]).alias("d")).where("d <> 0")
    ranked = average_ranks(d, F.abs("d"), "rank")
    sums = ranked.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("m"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.least("p", "m").alias("w"), "n")


def running_mean(df: DataFrame, value: str, order: list[str], window: int, name: str = "mean") -> DataFrame:
    """Mean of the last ``window`` values; the first ``window`` rows go. Sums are differences of distributed prefix sums."""
    from loomspan.operators.rows import with_ordinal

    numbered = with_ordinal(df, "_o", order)
    total = running_total(numbered.withColumn("_v", F.col(value).cast("double")), "_v", ["_o"], [])
    upto = total.withColumn("_upto", F.col("_before") + F.col("_v"))
    earlier = upto.select((F.col("_o") + window).alias("_o"), F.col("_upto").alias("_lag"))
    return upto.join(earlier, "_o").withColumn(name, (F.col("_upto") - F.col("_lag")) / window).drop("_v", "_before", "_upto", "_lag", "_o")


def sliding_sum(df: DataFrame, value: str, order: list[str], window: int, *, normalise: bool = False) -> DataFrame:
    """``x, y``: sum (or mean) of the values at [x - ceil(w/2), x + floor(w/2)), for every x with a whole window; w = 1 gives the values.

    Summed by ordinal from window-sized blocks: each value is sent to the blocks next to its own, so that frames
    are local.
    """
    from loomspan.operators.rows import with_ordinal

    numbered = with_ordinal(df, "_o", order).select("_o", F.col(value).cast("double").alias("_v"))
    if window == 1:
        return numbered.select(F.col("_o").alias("x"), F.col("_v").alias("y"))
    left, right = math.ceil(window / 2), window // 2
    size = numbered.count()
    block = max(4096, 4 * window)
    home = F.floor(F.col("_o") / block)
    near = F.array_distinct(F.array(home, F.floor((F.col("_o") - right) / block), F.floor((F.col("_o") + left) / block)))
    spread = numbered.withColumn("_b", F.explode(near))
    frame = Window.partitionBy("_b").orderBy("_o").rowsBetween(-left, right - 1)
    y = F.sum("_v").over(frame)
    out = spread.select(F.col("_o").alias("x"), (y / window if normalise else y).alias("y"), (F.col("_b") == home).alias("_mine"))
    return out.where(F.col("_mine") & (F.col("x") >= left) & (F.col("x") < size - right)).drop("_mine")


def density(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``x, density``: gaussian kernel density (Scott's bandwidth) at ``bins`` places, normalised to sum 1."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    stats = v.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("s")).first()
    if not stats.n or not stats.s:
        return v.sparkSession.createDataFrame([], "x double, density double")
    h = stats.s * stats.n ** (-1 / 5)
    places = [low + (high - low) * i / max(bins - 1, 1) for i in range(bins)]
    sums = v.agg(F.array(*[F.sum(F.exp(-0.5 * F.pow((F.lit(x) - F.col("v")) / h, 2))) for x in places]).alias("y"))
    rows = sums.select(F.arrays_zip(F.array(*[F.lit(x) for x in places]).alias("x"), F.col("y")).alias("z"), F.aggregate("y", F.lit(0.0), lambda a, b: a + b).alias("t"))
    flat = rows.select(F.explode("z").alias("z"), "t")
    first, second = flat.schema["z"].dataType.names
    return flat.select(F.col(f"z.{first}").alias("x"), (F.col(f"z.{second}") / F.col("t")).alias("density"))


def adjust(df: DataFrame, p: str, key: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg values of a column of p-values; null stays null.

    Ties go by ``key``. The rank is a distributed ordinal; the running minimum from the largest p down is taken inside blocks of
    ranks, with the least of the later blocks carried in.
    """
    some = with_ordinal(df.where(F.col(p).isNotNull()), "_r", [p, key])
    n = df.where(F.col(p).isNotNull()).agg(F.count(F.lit(1))).scalar()
    raw = some.withColumn("_n", n).withColumn("_q", F.col(p) * F.col("_n") / (F.col("_r") + 1)).withColumn("_b", F.shiftright("_r", 16))
    down = Window.partitionBy("_b").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy().orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carried = raw.groupBy("_b").agg(F.min("_q").alias("_l")).select("_b", F.min("_l").over(later).alias("_later"))
    low = raw.withColumn("_low", F.min("_q").over(down)).join(carried, "_b")
    done = low.withColumn(name, F.least("_low", F.coalesce("_later", F.lit(1.0)), F.lit(1.0))).select(*df.columns, name)
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def tests_against(df: DataFrame, names: list[str], baseline: str, *, test: str = "welch") -> list[tuple[str, float, float]]:
    """(condition, p, q) of each condition against the baseline (p = 1 for itself): ``welch``, ``student`` or ``mannwhitneyu``."""
    made = {
        "welch": lambda n: ttest_p(df, names, baseline, n)[1],
        "student": lambda n: ttest_p(df, names, baseline, n, equal_var=True)[1],
        "mannwhitneyu": lambda n: mannwhitney_p(df, names, baseline, n)[1],
    }
    ps = [1.0 if n == baseline else made[test](n) for n in names]
    order = sorted(range(len(ps)), key=lambda i: -ps[i])
    low, qs = 1.0, [1.0] * len(ps)
    for k, i in enumerate(order):
        low = min(low, ps[i] * len(ps) / (len(ps) - k))
        qs[i] = low
    return list(zip(names, ps, qs))


def scaled_spread(df: DataFrame, value: str, by: list[str], width: float) -> DataFrame:
    """``by..., count, mean, std`` of value / width (sample deviation)."""
    v = F.col(value) / width
    return df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
