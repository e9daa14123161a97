"""Joins of lists on a key."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.rows import distinct_on


def map_join(left: DataFrame, right: DataFrame, key: str, *, logic: str = "and", greedy: bool = True, order: list[str] | None = None, arrays: tuple[str, ...] = (), same_names: bool = True) -> DataFrame:
    """Join ``left`` to ``right`` on ``key`` (null matches null); columns of ``right`` win.

    ``logic='and'``: one row per match; ``greedy=False`` takes only the first left match by ``order``.
    ``logic='notright'``: rows of ``right`` without a match. ``arrays`` are concatenated right + left unless
    ``same_names``.
    """
    if logic == "notright":
        other = left.select(F.col(key).alias("_key")).distinct()
        return right.join(other, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    if logic != "and":
        raise ValueError(f"unknown logic {logic!r}")
    if not greedy:
        if not order:
            raise ValueError("the first match needs an order")
        left = distinct_on(left, [key], order)
    renamed = left.select(*[F.col(c).alias(f"_l_{c}") for c in left.columns])
    joined = right.join(renamed, F.col(key).eqNullSafe(F.col(f"_l_{key}")))
    out = []
    for c in right.columns:
        both = c in arrays and c in left.columns and not same_names
        out.append((F.concat(F.col(c), F.col(f"_l_{c}")) if both else F.col(c)).alias(c))
    return joined.select(*out, *[F.col(f"_l_{c}").alias(c) for c in left.columns if c not in right.columns])


def merge_tables(tables: list[DataFrame], key: str, values: str = "conditions") -> DataFrame:
    """``key, values``: rows in all tables, their arrays one behind another. A key must be unique in every table: a repeated one is an error."""

    def once(df: DataFrame, i: int) -> DataFrame:
        lone = F.when(F.count(F.lit(1)) == 1, F.first(values)).otherwise(F.raise_error(F.lit(f"key is not unique in table {i}")))
        return df.groupBy(key).agg(lone.alias(f"_v{i}"))

    parts = [once(t, i) for i, t in enumerate(tables)]
    joined = functools.reduce(lambda a, b: a.join(b, key), parts)
    return joined.select(key, F.concat(*[F.col(f"_v{i}") for i in range(len(tables))]).alias(values))


def hits_along(ranked: DataFrame, members: DataFrame, key: str, score: str | None = None) -> DataFrame:
    """``ranked`` with ``hit``: 1 for keys in ``members`` (or the sum of their scores), else 0."""
    weight = F.sum(score) if score else F.lit(1)
    known = members.groupBy(key).agg(weight.cast("double").alias("hit"))
    return ranked.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
