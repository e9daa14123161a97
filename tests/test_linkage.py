"""Trees of many points and the heat map made from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import learn


def _nodes(merges, n):
    """Leaves of every node above height 0, and its height."""
    at, out = {i: frozenset([i]) for i in range(n)}, {}
    for k, (a, b, height, size) in enumerate(merges):
        at[n + k] = at[int(a)] | at[int(b)]
        assert len(at[n + k]) == size
        out[at[n + k]] = height
    return {leaves: height for leaves, height in out.items() if height > 1e-7}


@pytest.mark.parametrize("method", ["complete", "average", "ward", "single"])
def test_tree_of_groups_is_the_tree_of_all_distances(monkeypatch, method):
    rng = np.random.default_rng(3)
    spread, packed, line = rng.normal(size=(500, 6)), rng.normal(0, 0.05, (500, 5)) + rng.integers(0, 4, (500, 1)), rng.exponential(size=(300, 1)) ** 3
    repeated = np.repeat(rng.normal(size=(100, 4)), 4, axis=0)[rng.permutation(400)]
    for x in (spread, packed, line, repeated, rng.normal(size=(150, 40))):
        monkeypatch.setattr(learn, "DENSE_POINTS", 2000)
        whole = _nodes(learn.linkage(x, method), len(x))
        for few, loose in ((1, 1_000_000), (60, 1_000_000), (1, 10)):
            monkeypatch.setattr(learn, "DENSE_POINTS", few)
            monkeypatch.setattr(learn, "LOOSE_PAIRS", loose)
            parts = _nodes(learn._group_linkage(x, method), len(x))
            assert parts.keys() == whole.keys() and all(np.isclose(parts[k], whole[k]) for k in whole)


def test_large_groups_beside_many_lone_points(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.01, (1500, 3)), rng.normal(0, 0.01, (1500, 3)) + [1, 0, 0], rng.uniform(50, 1000, (700, 3))])
    monkeypatch.setattr(learn, "DENSE_POINTS", 4000)
    whole = _nodes(learn.linkage(x), len(x))
    monkeypatch.setattr(learn, "DENSE_POINTS", 400)
    parts = _nodes(learn._group_linkage(x), len(x))  # compares two groups of 1,500 points
    assert parts.keys() == whole.keys() and all(np.isclose(parts[k], whole[k]) for k in whole)


def test_tree_of_groups_ends_on_ties(monkeypatch):
    monkeypatch.setattr(learn, "DENSE_POINTS", 10)
    grid = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), axis=-1).reshape(-1, 3)
    for x in (grid, np.zeros((40, 3)), -0.0 * np.arange(30.0)[:, None]):
        for method in ("complete", "average", "ward", "single"):
            merges = learn._group_linkage(x, method)
            assert len(merges) == len(x) - 1 and (np.diff(merges[:, 2]) >= 0).all() and sorted(learn.leaf_order(merges, len(x))) == list(range(len(x)))


def test_heat_payload_of_more_rows_than_a_dense_tree_takes(spark):
    n, kinds = learn.MOST_POINTS + 300, 2300
    kind = F.col("rid") % kinds
    df = spark.range(n).withColumnRenamed("id", "rid").select("rid", F.array(kind % 47, (kind * 31) % 101, F.sqrt(kind)).cast("array<double>").alias("conditions"))
    got = learn.heat_payload(df.repartition(7), "rid", ["a", "b", "c"]).toPandas()
    assert len(got) == 3 * n and sorted(got[got.cond == "b"].row_order) == list(range(n)) and sorted(got.col_order.unique()) == [0, 1, 2]
    wide = got.pivot(index="rid", columns="cond", values="value").loc[range(n)]
    k = np.arange(n) % kinds
    assert np.array_equal(wide.to_numpy(), np.stack([k % 47, (k * 31) % 101, np.sqrt(k)], axis=1))
    place = got[got.cond == "a"].set_index("rid").row_order
    span = place.groupby(place.index % kinds).agg(["min", "max", "count"])
    assert (span["max"] - span["min"] + 1 == span["count"]).all()  # equal rows lie together
    again = learn.heat_payload(df.repartition(3), "rid", ["a", "b", "c"]).toPandas()
    assert again[again.cond == "a"].set_index("rid").row_order.loc[place.index].equals(place)


def test_heat_payload_of_no_rows(spark):
    got = learn.heat_payload(spark.createDataFrame([], "k string, conditions array<double>"), "k", ["a", "b"])
    assert got.count() == 0 and got.columns == ["k", "cond", "value", "row_order", "col_order"]
