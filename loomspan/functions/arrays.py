"""Array expressions: bins, resampling, predicates over conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def bin_sums(v: Column, size: int) -> Column:
    """Sums of pieces of ``size`` elements; the last piece may be shorter; an empty array gives an empty one."""
    starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: _total(F.slice(v, k * size + 1, F.lit(size))))


def bin_means(v: Column, size: int) -> Column:
    starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: _total(F.slice(v, k * size + 1, F.lit(size))) / F.size(F.slice(v, k * size + 1, F.lit(size))))


def rescale(v: Column, bins: int) -> Column:
    """Resample to ``bins`` values by averaging the elements that fall into each; a bin without one takes the element under it."""
    low = lambda k: F.floor(k * F.size(v) / bins).cast("int")
    piece = lambda k: F.slice(v, low(k) + 1, F.greatest(low(k + 1) - low(k), F.lit(1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: _total(piece(k)) / F.size(piece(k)))


def index_where(v: Column, test) -> Column:
    """Place (from 0) of the first element that meets the test, -1 if none does."""
    return F.array_position(F.transform(v, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True)).cast("int") - 1


def ratio(v: Column, names: list[str], base: str) -> Column:
    """First condition that isn't the base, over the base."""
    other = next(i for i, n in enumerate(names) if n != base)
    return F.try_divide(v[other], v[names.index(base)])


def fold_up(v: Column, names: list[str], base: str, times: float = 2.0) -> Column:
    return ratio(v, names, base) > times


def fold_down(v: Column, names: list[str], base: str, times: float = 2.0) -> Column:
    return ratio(v, names, base) < 1 / times


def fold_either(v: Column, names: list[str], base: str, times: float = 2.0) -> Column:
    return fold_up(v, names, base, times) | fold_down(v, names, base, times)
