"""Labelled numeric matrices: rows with an array of values, one per named condition.

The names travel beside the frame as a list. Row-wise operators are array expressions inside whole-stage
codegen; column-wise ones aggregate all columns in one pass to a single row, which is joined back as a
scalar subquery.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = "conditions"


def clean(value: Column) -> Column:
    """Numbers for a matrix: null, NaN and text that is no number become 0."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def to_matrix(df: DataFrame, columns: list[str], *, keep: list[str] | None = None) -> DataFrame:
    """Pack condition columns into one array."""
    rest = keep if keep is not None else [c for c in df.columns if c not in columns]
    return df.select(*rest, F.array(*[clean(F.col(c)) for c in columns]).alias(V))


def to_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != V], *[F.col(V)[i].alias(n) for i, n in enumerate(names)])


def to_long(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``keys..., ix, cond, value``: one row per entry."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode(V).alias("ix", "value")).withColumn("cond", labels[F.col("ix")]).select(*keys, "ix", "cond", "value")


def to_wide(df: DataFrame, names: list[str], keys: list[str], cond: str = "cond", value: str = "value") -> DataFrame:
    """Long form to arrays; a missing entry is 0, of repeated ones the sum counts. No pivot job: the names are given."""
    sums = [F.coalesce(F.sum(F.when(F.col(cond) == n, F.col(value))), F.lit(0.0)).cast("double") for n in names]
    return df.groupBy(*keys).agg(F.array(*sums).alias(V))


def each(df: DataFrame, f) -> DataFrame:
    return df.withColumn(V, F.transform(V, f))


def slice_conditions(df: DataFrame, names: list[str], wanted: list[str], *, err: str | None = None) -> DataFrame:
    at = [names.index(n) for n in wanted]
    for c in [V, *([err] if err else [])]:
        df = df.withColumn(c, F.array(*[F.col(c)[i] for i in at]))
    return df


def sorted_conditions(names: list[str], reverse: bool = False) -> list[str]:
    """Case-insensitive order of the names, for ``slice_conditions``."""
    return sorted(names, key=str.lower, reverse=reverse)


def check_unique(names: list[str]) -> None:
    if len(set(names)) != len(names):
        raise ValueError("condition names are not unique")


def columns_by_sum(df: DataFrame, names: list[str]) -> list[str]:
    """Names by ascending column sum; one small aggregate."""
    sums = df.agg(*[F.sum(F.col(V)[i]) for i in range(len(names))]).first()
    return [n for _, n in sorted(zip([s or 0.0 for s in sums], names), key=lambda x: x[0])]


def drop_errors(df: DataFrame, err: str = "err") -> DataFrame:
    return df.drop(err)


# --- row-wise ---------------------------------------------------------------------------------------


def total(v: Column | str = V) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column | str = V) -> Column:
    return F.try_divide(total(v), F.size(v))


def deviation(v: Column | str = V) -> Column:
    """Population standard deviation of an array."""
    m = mean(v)
    return F.sqrt(F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(v)))


def log(df: DataFrame, base: float = math.e, pad: float = 0.1) -> DataFrame:
    return each(df, lambda x: F.ln(x + pad) / math.log(base))


def unlog(df: DataFrame, base: float = math.e, adjuster: float = 0.1) -> DataFrame:
    """``base ** (value + adjuster)``; as defined, not the inverse of ``log``."""
    return each(df, lambda x: F.pow(F.lit(float(base)), x + adjuster))


def mult(df: DataFrame, number: float) -> DataFrame:
    return each(df, lambda x: x * number)


def plus(df: DataFrame, number: float) -> DataFrame:
    return each(df, lambda x: x + number)


def minus(df: DataFrame, number: float) -> DataFrame:
    return each(df, lambda x: x - number)


def abssub(df: DataFrame, number: float) -> DataFrame:
    """Move every value towards 0 by ``number``, not past it."""
    zero = F.lit(0.0)
    return each(df, lambda x: F.when(x >= 0, F.greatest(x - number, zero)).otherwise(F.least(x + number, zero)))


def bracket(df: DataFrame, low: float, high: float) -> DataFrame:
    return each(df, lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def coerce(df: DataFrame, kind: str) -> DataFrame:
    return each(df, lambda x: x.cast(kind))


def row_z(df: DataFrame, *, row_variance: bool = True) -> DataFrame:
    """Row z-scores with the population deviation of the row, or of the whole matrix; no deviation gives 0."""
    df = df.withColumn("_m", mean())
    if row_variance:
        df = df.withColumn("_s", deviation())
    else:
        df = df.withColumn("_s", df.select(F.explode(V).alias("x")).agg(F.stddev_pop("x")).scalar())
    out = each(df, lambda x: F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s")).otherwise(0.0))
    return out.drop("_m", "_s")


def normalize_rows(df: DataFrame) -> DataFrame:
    """Each value's place between the row's smallest and largest absolute value."""
    size = F.transform(V, lambda x: F.abs(x))
    df = df.withColumn("_lo", F.array_min(size)).withColumn("_hi", F.array_max(size))
    return each(df, lambda x: F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def fold(c1: Column, c2: Column, log_base: float | None = 2.0) -> Column:
    """Symmetric fold change of c2 over c1 (both padded): logarithm, or the ratio, negative when down."""
    up, down = c2 / c1, c1 / c2
    if log_base:
        k = math.log(log_base)
        return F.when(c2 > c1, F.ln(up) / k).otherwise(-F.ln(down) / k)
    return F.when(c2 > c1, up).otherwise(-down)


def add_fold_change(df: DataFrame, names: list[str], cond1: str, cond2: str, *, key: str = "fc", log_base: float | None = 2.0, pad: float = 1e-6, err: str | None = None) -> DataFrame:
    """Fold change of ``cond2`` over ``cond1``; with ``err`` the smaller size of the two bounds, in column ``err``."""
    i, j = names.index(cond1), names.index(cond2)
    c1, c2 = F.col(V)[i] + pad, F.col(V)[j] + pad
    out = df.withColumn(key, fold(c1, c2, log_base))
    if err:
        low, high = fold(c1, c2 - F.col(err)[j], log_base), fold(c1, c2 + F.col(err)[j], log_base)
        out = out.withColumn(f"{key}_err", F.least(F.abs(low), F.abs(high)))
    return out


def normalise_to_condition(df: DataFrame, names: list[str], base: str, *, use_fold_change: bool = False, keep_normed: bool = False, pad: float = 1e-6, log_base: float | None = 2.0) -> tuple[DataFrame, list[str]]:
    """Every other condition as 2 ** -(base / value), or its fold change; the base goes, or stays as 0.5 (0 for fold changes)."""
    b = F.col(V)[names.index(base)] + pad
    out, kept = [], []
    for i, n in enumerate(names):
        x = F.col(V)[i] + pad
        if n != base:
            out.append(fold(b, x, log_base) if use_fold_change else F.pow(F.lit(2.0), -(b / x)))
            kept.append(n)
        elif keep_normed:
            out.append(F.lit(0.0 if use_fold_change else 0.5))
            kept.append(n)
    return df.withColumn(V, F.array(*out)), kept


def norm_multi_fc(df: DataFrame, names: list[str], bases: dict[str, list[str]], *, pad: float = 1e-6, log_base: float | None = 2.0) -> DataFrame:
    """Fold changes against each condition's own base; bases and conditions without one are 0."""
    base_of = {n: b for b, some in bases.items() for n in some}
    made = [fold(F.col(V)[names.index(base_of[n])] + pad, F.col(V)[i] + pad, log_base) if n in base_of else F.lit(0.0) for i, n in enumerate(names)]
    return df.withColumn(V, F.array(*made))


def mean_replicates(df: DataFrame, names: list[str], groups: list[list[str]], *, err: str = "err") -> tuple[DataFrame, list[str]]:
    """Groups of replicates as their mean, at the place of the first member and under its name; ``err`` is deviation / root of n, 0 for single ones."""
    member = {n: g for g in groups for n in g}
    values, errors, kept = [], [], []
    for i, n in enumerate(names):
        g = member.get(n)
        if g is None:
            values.append(F.col(V)[i])
            errors.append(F.lit(0.0))
        elif g[0] == n:
            some = F.array(*[F.col(V)[names.index(m)] for m in g])
            values.append(mean(some))
            errors.append(deviation(some) / math.sqrt(len(g)))
        else:
            continue
        kept.append(n)
    return df.withColumn(err, F.array(*errors)).withColumn(V, F.array(*values)), kept


def replicate_correlations(df: DataFrame, names: list[str], groups: list[list[str]]) -> DataFrame:
    """``a, b, r``: Pearson correlation of each pair of replicates, in one pass."""
    pairs = [(a, b) for g in groups for k, a in enumerate(g) for b in g[k + 1 :]]
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(V)[names.index(a)], F.col(V)[names.index(b)]).alias("r")) for a, b in pairs]
    return df.agg(F.array(*made).alias("p")).select(F.inline("p"))


# --- column-wise ------------------------------------------------------------------------------------


def _columns(df: DataFrame, names: list[str], f) -> Column:
    """Array with one aggregate per column, as a scalar subquery."""
    return df.agg(F.array(*[f(F.col(V)[i]) for i in range(len(names))])).scalar()


def _with(df: DataFrame, names: list[str], made: dict) -> DataFrame:
    for name, f in made.items():
        df = df.withColumn(name, _columns(df.select(V), names, f))
    return df


def subtract_mean(df: DataFrame, names: list[str]) -> DataFrame:
    out = _with(df, names, {"_m": F.avg})
    return out.withColumn(V, F.zip_with(V, "_m", lambda x, m: x - m)).drop("_m")


def whiten(df: DataFrame, names: list[str]) -> DataFrame:
    """Divide by the column's population deviation; a constant column stays."""
    out = _with(df, names, {"_s": F.stddev_pop})
    return out.withColumn(V, F.zip_with(V, "_s", lambda x, s: F.when(s > 0, x / s).otherwise(x))).drop("_s")


def column_z(df: DataFrame, names: list[str], *, column_variance: bool = True) -> DataFrame:
    out = _with(df, names, {"_m": F.avg, "_s": F.stddev_pop})
    if not column_variance:
        whole = df.select(F.explode(V).alias("x")).agg(F.stddev_pop("x")).scalar()
        out = out.withColumn("_s", F.array_repeat(whole, len(names)))
    z = F.transform(V, lambda x, i: F.when(F.get("_s", i) > 0, (x - F.get("_m", i)) / F.get("_s", i)).otherwise(0.0))
    return out.withColumn(V, z).drop("_m", "_s")


def normalize(df: DataFrame) -> DataFrame:
    """Whole matrix to 0..1."""
    flat = df.select(F.explode(V).alias("x"))
    out = df.withColumn("_lo", flat.agg(F.min("x")).scalar()).withColumn("_hi", flat.agg(F.max("x")).scalar())
    return each(out, lambda x: F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def normalize_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Every column to -1..1."""
    out = _with(df, names, {"_lo": F.min, "_hi": F.max})
    place = F.transform(V, lambda x, i: 1 - 2 * F.coalesce(F.try_divide(F.get("_hi", i) - x, F.get("_hi", i) - F.get("_lo", i)), F.lit(0.0)))
    return out.withColumn(V, place).drop("_lo", "_hi")


def digitize(df: DataFrame, steps: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """ceil((x - low) / (high - low) * steps); bounds of the matrix unless given."""
    flat = df.select(F.explode(V).alias("x"))
    lo = F.lit(float(low)) if low is not None else flat.agg(F.min("x")).scalar()
    hi = F.lit(float(high)) if high is not None else flat.agg(F.max("x")).scalar()
    out = df.withColumn("_lo", lo).withColumn("_hi", hi)
    return each(out, lambda x: F.ceil((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * steps).cast("double")).drop("_lo", "_hi")


def quantile_normalise(df: DataFrame, names: list[str], key: str) -> DataFrame:
    """Values replaced by the mean, over columns, of the values of the same rank; equal values of a column get one value.

    Tied values get the median of the means of their ranks. As those means grow with the rank, the median is that of the middle
    ranks, so a tie of a third of all rows is one row here. A rank is a distributed ordinal, not a single-task
    window, and needs a sort of each column. An empty table stays empty.
    """
    from loomspan.operators.rows import with_ordinal

    long = to_long(df, names, [key])
    ordered = with_ordinal(long, "_o", ["ix", "value", key])
    first = ordered.groupBy("ix").agg(F.min("_o").alias("_first"))  # one row per column
    ranked = ordered.join(F.broadcast(first), "ix").withColumn("_rank", F.col("_o") - F.col("_first"))
    means = ranked.groupBy("_rank").agg(F.avg("value").alias("_mean"))
    ties = ranked.groupBy("ix", "value").agg(F.min("_rank").alias("_at"), F.count(F.lit(1)).alias("_n"))
    low, high = F.col("_at") + F.floor((F.col("_n") - 1) / 2), F.col("_at") + F.floor(F.col("_n") / 2)
    middle = ties.select("ix", "value", low.alias("_rank"), high.alias("_high")).join(means, "_rank").withColumnRenamed("_mean", "_low_mean").drop("_rank")
    middle = middle.withColumnRenamed("_high", "_rank").join(means, "_rank").select("ix", "value", ((F.col("_low_mean") + F.col("_mean")) / 2).alias("_mean"))
    placed = ranked.select("ix", "value", key).join(middle, ["ix", "value"])
    back = placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "_mean"))), lambda s: s["_mean"]).alias(V))
    return df.drop(V).join(back, key)


# --- filters ----------------------------------------------------------------------------------------


def count_over(limit: float) -> Column:
    return F.size(F.filter(V, lambda x: x > limit))


def keep_any_over(df: DataFrame, value: float, *, absolute: bool = False) -> DataFrame:
    return df.where(F.exists(V, lambda x: (F.abs(x) if absolute else x) > value))


def keep_low_expressed(df: DataFrame, minimum: float, number: int) -> DataFrame:
    """Rows with at least ``number`` conditions over ``minimum``."""
    return df.where(count_over(minimum) >= number)


def keep_high_expressed(df: DataFrame, maximum: float, number: int) -> DataFrame:
    """Rows with at most ``number`` conditions over ``maximum``."""
    return df.where(count_over(maximum) <= number)


def keep_by_mean(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(mean().between(low, high))


def keep_condition(df: DataFrame, names: list[str], name: str, minimum: float) -> DataFrame:
    return df.where(F.col(V)[names.index(name)] >= minimum)


def keep_low_and_high(df: DataFrame, low: float, high: float, number: int) -> DataFrame:
    """Rows with at least ``number`` conditions below ``low`` or over ``high``."""
    return df.where(F.size(F.filter(V, lambda x: x < low)) + F.size(F.filter(V, lambda x: x > high)) >= number)


def keep_by_cv(df: DataFrame, low: float, high: float, pad: float = 0.1) -> DataFrame:
    """Rows with low < deviation / (mean + pad) < high, which is added as ``CV``."""
    out = df.withColumn("CV", F.try_divide(deviation(), mean() + pad))
    return out.where((F.col("CV") > low) & (F.col("CV") < high))


def keep_by_fold(df: DataFrame, key: str = "fc", direction: str = "any", value: float = 2.0) -> DataFrame:
    x = F.col(key)
    tests = {"up": x >= value, "down": x <= -value, "any": (x >= value) | (x <= -value)}
    return df.where(tests[direction])


def sort_by_sum(df: DataFrame, names: list[str], order: list[str], selected: list[str] | None = None) -> DataFrame:
    some = F.array(*[F.col(V)[names.index(n)] for n in selected]) if selected else F.col(V)
    return df.orderBy(total(some), *order)


# --- likeness ---------------------------------------------------------------------------------------


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays of one length; null without variance."""
    mx, my = mean(x), mean(y)
    pairs = F.zip_with(x, y, lambda a, b: (a - mx) * (b - my))
    var = lambda v, m: F.aggregate(v, F.lit(0.0), lambda a, e: a + (e - m) * (e - m))
    return F.try_divide(total(pairs), F.sqrt(var(x, mx) * var(y, my)))


def bundle(df: DataFrame, seeds: list[tuple[str, list[float]]], key: str, *, z: float = 0.9, negative: bool = False) -> DataFrame:
    """``key, seed, r``: rows with the seed profile they follow best, if r > z (or r < -z with ``negative``).

    The seeds are given with the call and become literals: no join.
    """
    made = [F.struct(pearson(F.col(V), F.array(*[F.lit(float(x)) for x in p])).alias("r"), F.lit(n).alias("seed")) for n, p in seeds]
    size = (lambda s: F.abs(s["r"])) if negative else (lambda s: s["r"])
    best = F.element_at(F.array_sort(F.filter(F.array(*made), lambda s: s["r"].isNotNull()), lambda a, b: F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).otherwise(F.when(a["seed"] < b["seed"], -1).otherwise(1))), 1)
    out = df.withColumn("_best", F.when(F.size(F.filter(F.array(*made), lambda s: s["r"].isNotNull())) > 0, best))
    return out.where((F.abs("_best.r") if negative else F.col("_best.r")) > z).select(key, F.col("_best.seed").alias("seed"), F.col("_best.r").alias("r"))


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """``a, b, r`` for all pairs of conditions, from one pass over the rows."""
    n = len(names)
    made = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.corr(F.col(V)[i], F.col(V)[j]).alias("r")) for i in range(n) for j in range(i, n)]
    half = df.agg(F.array(*made).alias("p")).select(F.inline("p"))
    return half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def network_edges(df: DataFrame, names: list[str], *, low: float = 0.5, high: float = 0.9, most_links: int = 5) -> DataFrame:
    """``a, b, r, strong``: each condition's ``most_links`` best partners with r >= low; strong from ``high`` on."""
    from pyspark.sql import Window

    r = correlation_matrix(df, names).where("a <> b and r is not null").where(F.col("r") >= low)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), "b"))
    return r.withColumn("k", place).where(F.col("k") <= most_links).select("a", "b", "r", (F.col("r") >= high).alias("strong"))



def from_pandas(spark, frame, condition_names: list[str]) -> DataFrame:
    """A pandas frame's condition columns packed into the array."""
    return to_matrix(spark.createDataFrame(frame), condition_names)


def cut(df: DataFrame, predicate) -> DataFrame:
    """Rows for which ``predicate``, a function from the frame to a Column, holds."""
    return df.where(F.coalesce(predicate(df), F.lit(False)))


def insert_condition(df: DataFrame, key: str, data: DataFrame, value: str, *, low: float | None = None, high: float | None = None) -> DataFrame:
    """Append one condition from ``data`` (``key, value``), rescaled to [low, high] if given; rows must match one to one."""
    v = F.col(value).cast("double")
    new = data.select(F.col(key).alias("_k"), v.alias("_v"))
    if low is not None:
        new = new.withColumn("_a", new.agg(F.min("_v")).scalar()).withColumn("_b", new.agg(F.max("_v")).scalar())
        new = new.select("_k", (low + (F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low)).alias("_v"))
    return df.join(new, df[key] == F.col("_k")).withColumn(V, F.concat(V, F.array("_v"))).drop("_k", "_v")
