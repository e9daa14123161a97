"""Row and column operators on annotated lists.

Order-sensitive operators take ``order``: the columns that give every row its place (a row number column
or a unique key). They never add a global sort where a partitioned one will do.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import checkpointed


def falsy(df: DataFrame, name: str) -> Column:
    """Null, empty text, zero, false or an empty array: what counts as an empty value."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    if kind == "string":
        return c.isNull() | (c == "")
    if kind == "boolean":
        return c.isNull() | ~c
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    if kind in ("struct", "timestamp", "date", "binary"):
        return c.isNull()
    return c.isNull() | (c == 0)


def select_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys)


def rename_key(df: DataFrame, old: str, new: str, *, keep_old: bool = False, replace: bool = False) -> DataFrame:
    """Rename a column, or copy it if ``keep_old``; an existing ``new`` is an error unless ``replace``."""
    if new in df.columns and new != old:
        if not replace:
            raise ValueError(f"column {new!r} exists")
        df = df.drop(new)
    return df.withColumn(new, F.col(old)) if keep_old else df.withColumnRenamed(old, new)


def add_key(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column; replaces one of that name."""
    return df.withColumn(name, F.lit(value))


def label_rows(df: DataFrame, name: str, order: list[str], fmt: str = "ID_{}") -> DataFrame:
    """``fmt`` with each row's ordinal from 0, numbered without a single-task window.

    Rows are range-partitioned by ``order``; ordinals are the row's number in its partition plus the rows
    of earlier partitions (one row per partition is summed).
    """
    before, after = fmt.split("{}")
    numbered = with_ordinal(df, "_ordinal", order)
    return numbered.withColumn(name, F.concat(F.lit(before), F.col("_ordinal").cast("string"), F.lit(after))).drop("_ordinal")


def with_ordinal(df: DataFrame, name: str, order: list[str | Column]) -> DataFrame:
    """Ordinal from 0 in the given order, by a sort that stays distributed.

    The range partitions are checkpointed: their bounds are sampled, so a second evaluation could cut
    elsewhere and no longer fit the partition sizes.
    """
    part = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = part.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = part.groupBy("_p").count()
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return local.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + F.col("_n")).cast("bigint")).drop("_p", "_n", "_start")  # one row per partition


def fill_from(df: DataFrame, name: str, other: str) -> DataFrame:
    """Replace empty values (null, '', 0, false, []) of a column by those of another."""
    return df.withColumn(name, F.when(falsy(df, name), F.col(other)).otherwise(F.col(name)))


def split_pairs(df: DataFrame, name: str, keys: list[str], *, key_sep: str = " ", val_sep: str = ":") -> DataFrame:
    """Columns for ``keys`` out of text like ``k:v k2:v2``; the text column goes, tokens without ``val_sep`` don't count, the last of equal keys wins."""
    tokens = F.filter(F.split(F.col(name), _quote(key_sep)), lambda t: F.instr(t, val_sep) > 0)
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, val_sep, 1).alias("k"), F.substr(t, F.instr(t, val_sep) + len(val_sep)).alias("v")))

    def value(k: str) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("_pairs", lambda p: p["k"] == k), lambda p: p["v"])), -1).alias(k)

    rest = [c for c in df.columns if c != name and c not in keys]
    return df.withColumn("_pairs", pairs).select(*rest, *[value(k) for k in keys])


def pair_keys(df: DataFrame, name: str, *, key_sep: str = " ", val_sep: str = ":") -> list[str]:
    """All keys in a column of ``k:v`` tokens (read from the data; their number is the number of columns to be)."""
    tokens = F.filter(F.split(F.col(name), _quote(key_sep)), lambda t: F.instr(t, val_sep) > 0)
    rows = df.select(F.explode(F.transform(tokens, lambda t: F.substring_index(t, val_sep, 1)))).distinct().collect()
    return sorted(r[0] for r in rows)


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def join_keys(df: DataFrame, new: str, fmt: str, a: str, b: str, *, keep: bool = False) -> DataFrame:
    """``fmt`` with the values of two columns in place of its two ``{}``; null if either is null."""
    x, y, z = fmt.split("{}")
    out = df.withColumn(new, F.concat(F.lit(x), F.col(a).cast("string"), F.lit(y), F.col(b).cast("string"), F.lit(z)))
    return out if keep else out.drop(*[c for c in (a, b) if c != new])


def act(df: DataFrame, operation: str, a: str, b: str, result: str | None = None) -> DataFrame:
    """``add sub mul div pow cat`` of two columns; division by zero gives 0."""
    x, y = F.col(a), F.col(b)
    made = {
        "add": lambda: x + y,
        "sub": lambda: x - y,
        "mul": lambda: x * y,
        "div": lambda: F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x.cast("double"), y.cast("double"))),
        "pow": lambda: F.pow(x, y),
        "cat": lambda: F.concat(x.cast("string"), y.cast("string")),
    }
    sign = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "^", "cat": "+"}
    if operation not in made:
        raise ValueError(f"unknown operation {operation!r}")
    return df.withColumn(result or f"{a}{sign[operation]}{b}", made[operation]())


def unfold(df: DataFrame, name: str) -> DataFrame:
    """One row per element of an array column; rows with a null or empty array go."""
    return df.withColumn(name, F.explode(name))


def get(df: DataFrame, key: str, value, order: list[str] | None = None) -> DataFrame:
    """Rows whose key equals the value (null equals null); with ``order`` only the first."""
    hits = df.where(F.col(key).eqNullSafe(F.lit(value)))
    return hits.orderBy(*order).limit(1) if order else hits


def index_of(df: DataFrame, key: str, value, ordinal: str) -> DataFrame:
    """``index`` of the first row with the value, null if there is none."""
    return df.where(F.col(key).eqNullSafe(F.lit(value))).agg(F.min(ordinal).alias("index"))


def find_any(df: DataFrame, value: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """First row in which any key, as text, equals the value."""
    same = [F.coalesce(F.col(c).cast("string") == value, F.lit(False)) for c in keys or df.columns]
    return df.where(functools.reduce(operator.or_, same)).orderBy(*order).limit(1)


def rows_by_pattern(df: DataFrame, patterns: list[str], key: str | None = None, *, use_re: bool = True, case_sensitive: bool = True) -> DataFrame:
    """Rows that match a pattern, once for every pattern they match; ``key=None`` looks at all text columns."""
    keys = [key] if key else [f.name for f in df.schema if f.dataType.typeName() == "string"]

    def hit(p: str) -> Column:
        if use_re:
            tests = [F.col(k).rlike(p if case_sensitive else f"(?i){p}") for k in keys]
        else:
            tests = [(F.col(k) == p) if case_sensitive else (F.lower(F.col(k)) == p.lower()) for k in keys]
        return functools.reduce(operator.or_, [F.coalesce(t, F.lit(False)) for t in tests])

    times = functools.reduce(operator.add, [hit(p).cast("int") for p in patterns])
    return df.withColumn("_times", times).where("_times > 0").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def filter_in(df: DataFrame, key: str, value, *, remove: bool = True) -> DataFrame:
    """Drop (or keep) rows whose text contains the value, or whose array has it; null contains nothing."""
    array = df.schema[key].dataType.typeName() == "array"
    has = F.coalesce(F.array_contains(key, value) if array else F.col(key).contains(value), F.lit(False))
    return df.where(~has if remove else has)


COMPARE = {
    "gt": operator.gt, ">": operator.gt, "lt": operator.lt, "<": operator.lt, "gte": operator.ge, ">=": operator.ge,
    "lte": operator.le, "<=": operator.le, "equal": operator.eq, "==": operator.eq,
}


def filter_value(df: DataFrame, key: str | Column, evaluator: str, value) -> DataFrame:
    return df.where(COMPARE[evaluator](F.col(key) if isinstance(key, str) else key, F.lit(value)))


def values_in_range(df: DataFrame, key: str, low, high) -> DataFrame:
    return df.where(F.col(key).between(low, high))


#: Chromosomes that count as canonical.
CANONICAL = [*map(str, range(1, 23)), "X", "Y", "M"]


def keep_chromosomes(df: DataFrame, chrom: str | Column, names: list[str] | None = None) -> DataFrame:
    """Rows on the named chromosomes, ``chr`` optional on both sides."""
    bare = F.regexp_replace(F.col(chrom) if isinstance(chrom, str) else chrom, "^chr", "")
    return df.where(bare.isin(*[n.removeprefix("chr") for n in names or CANONICAL]))


def remove_empty(df: DataFrame, key: str) -> DataFrame:
    """Drop rows whose value is empty (null, '', 0, false or [])."""
    return df.where(~falsy(df, key))


def remove(df: DataFrame, key: str, value) -> DataFrame:
    """Drop rows whose key equals the value."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row, by ``order``, of each combination of keys; combined map-side, so that a hot key isn't one task's work."""
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def exact_distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort_by(df: DataFrame, keys: list[str | Column], order: list[str], *, reverse: bool = False) -> DataFrame:
    """Stable sort; ``reverse`` reverses the whole list, ties included; nulls come first, last if reversed."""
    cols = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    return df.orderBy(*[c.desc_nulls_last() if reverse else c.asc_nulls_first() for c in cols])


def reverse(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order])


def shuffle(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Random order that repeats for the same seed, whatever the partitions."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key)


def sample(df: DataFrame, number: int, seed: int, key: list[str]) -> DataFrame:
    """``number`` rows without replacement, the same ones for the same seed (a top-k per partition, no full sort)."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(number)


def slice_rows(df: DataFrame, start: int, stop: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(max(0, stop - start))


def top_k(df: DataFrame, keys: list[str | Column], k: int, order: list[str], *, largest: bool = True) -> DataFrame:
    return sort_by(df, keys, order, reverse=largest).limit(k)


def value_counts(df: DataFrame, key: str, *, percents: bool = False) -> DataFrame:
    """``key, count`` of each value; with ``percents`` also its share of all rows in percent."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    if not percents:
        return counts
    return counts.withColumn("percent", F.col("count") * 100.0 / df.agg(F.count(F.lit(1))).scalar())


def frequency_background(df: DataFrame, backgrounds: DataFrame, key: str, list_col: str) -> DataFrame:
    """``key, count, mean, std``: counts beside mean and population std of the counts in background lists, absent ones as 0."""
    lists = backgrounds.agg(F.count_distinct(list_col)).scalar()
    each = backgrounds.groupBy(list_col, key).agg(F.count(F.lit(1)).alias("n"))
    stats = each.groupBy(key).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss")).withColumn("_lists", lists)
    mean = F.col("s") / F.col("_lists")
    stats = stats.select(key, mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("_lists") - mean * mean, F.lit(0.0))).alias("std"))
    out = value_counts(df, key).join(stats, key, "full_outer")
    return out.select(key, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def histogram(df: DataFrame, value: str | Column, low: float, high: float, bins: int, *, suppress_zeros: bool = False, log2: bool = False) -> DataFrame:
    """``bin, count`` of values in [low, high]; ``suppress_zeros`` drops values below 0.0001 in steps of it."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null and not isnan(v)")
    if suppress_zeros:
        rows = rows.where((F.col("v") * 10000).cast("bigint") > 0)
    if log2:
        rows = rows.withColumn("v", F.log2("v"))
    width = (high - low) / bins
    at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    return rows.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def volcano(df: DataFrame, q: str, fc: str, *, q_threshold: float = 2.0, fc_threshold: float = 1.0, log_q: bool = True, log_fc: bool = False) -> DataFrame:
    """Add ``minus_log_q``, ``log_fc`` and ``change`` (up, down, none) for a volcano or MA view."""
    x = F.log2(F.col(fc)) if log_fc else F.col(fc)
    y = -F.log10(F.col(q) + 1e-216) if log_q else F.col(q)
    change = F.when((x > fc_threshold) & (y > q_threshold), "up").when((x < -fc_threshold) & (y > q_threshold), "down").otherwise("none")
    return df.withColumn("log_fc", x).withColumn("minus_log_q", y).withColumn("change", change)


def make_unique(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Names made unique: the second and later of equal ones get ``_1``, ``_2``, ..."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), F.col("_n").cast("string")))).drop("_n")
