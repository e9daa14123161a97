"""List, interval, matrix, statistics and track operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import loci
from loomspan.functions.special import beta_inc, chi2_upper, t_two_sided
from loomspan.operators import intervals, keyjoin, learn, rows, sets, stats, tracks
from loomspan.operators import matrix as mx
from loomspan.operators.motifs import counts_to_weights, expand_word, motif_positions, mismatch_regexes, pwm_hits, rc_word, to_regex, window_scores
from loomspan.operators.periods import depth_runs

LOC = "struct<chrom: string, left: bigint, right: bigint>"


def spans(seed, n, size=3000, longest=60, chroms=2):
    rng = random.Random(seed)
    return [(i, (f"chr{rng.randrange(chroms)}", l := rng.randrange(size), l + rng.randrange(longest))) for i in range(n)]


def frame(spark, data, key="rid"):
    return spark.createDataFrame(data, f"{key} long, loc {LOC}")


def hit(a, b, d=0):
    return a[0] == b[0] and a[2] + d >= b[1] - d and a[1] - d <= b[2] + d


@pytest.mark.parametrize("delta", [0, 15])
@pytest.mark.parametrize("long_intervals", [False, True])
def test_overlap_matches_brute_force(spark, delta, long_intervals):
    a, b = spans(1, 80), spans(2, 90)
    a += [(900, ("chr0", -5000, 9000)), (901, None), (902, ("chr9", 1, 2))]
    x, y = frame(spark, a), frame(spark, b)
    opts = {"delta": delta, "bin_size": 16, "long_intervals": long_intervals}
    want = sorted((i, j) for i, p in a for j, q in b if p and hit(p, q, delta))
    got = intervals.overlap(x, y, keep_rank=True, **opts).select("rank_a", "rank_b").collect()
    assert sorted(tuple(r) for r in got) == want
    left = {i for i, _ in want}
    anti = {r.rid for r in intervals.overlap(x, y, logic="notinright", **opts).collect()}
    assert anti == {i for i, _ in a} - left
    both = intervals.overlap(x, y, logic="not", **opts).count()
    assert both == len(a) - len(left) + len(b) - len({j for _, j in want})
    assert intervals.overlap(x.limit(0), y, **opts).count() == 0


def test_collide_rows(spark):
    a, b = frame(spark, [(1, ("chr1", 100, 200))]), frame(spark, [(7, ("chr1", 540, 560)), (8, ("chr1", 551, 551)), (9, ("chr2", 150, 150))])
    out = intervals.collide(a, b, delta=200).collect()
    assert [(r.rid, r.dist, tuple(r.loc)) for r in out] == [(7, -400, ("chr1", 150, 550))]
    again = intervals.collide(a.withColumn("dist", F.lit("x")), b.withColumn("dist", F.lit("y")), delta=200)
    assert again.count() == 1


def brute_dedupe(data, wide):
    kept = []
    for i, l in sorted(data):
        if not any(hit(wide(l), wide(k)) for _, k in kept):
            kept.append((i, l))
    return {i for i, _ in kept}


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_matches_greedy(spark, seed):
    data = spans(seed, 150, size=1500)
    mid = lambda l, d=30: (l[0], (l[1] + l[2] >> 1) - d, (l[1] + l[2] >> 1) + d)
    df = frame(spark, [*data, (999, None)])
    got = {r.rid for r in intervals.dedupe_by_loc(df, delta=30).collect()}
    assert got == brute_dedupe(data, mid) | {999}
    got = {r.rid for r in intervals.dedupe_by_loc(df, mode="overlap", bin_size=50).collect()}
    assert got == brute_dedupe(data, lambda l: l) | {999}
    alone = {i for i, p in data if not any(j != i and hit(p, q) for j, q in data)}
    assert {r.rid for r in intervals.dedupe_by_loc(df, mode="overlap", delete_any_matches=True).collect()} == alone | {999}


def test_annotate_and_bands(spark):
    genes = [(1, ("chr1", 1000, 2000), "+"), (2, ("chr1", 5000, 6000), "-"), (3, ("chr1", 1000, 1500), "?")]
    g = spark.createDataFrame(genes, f"gid long, loc {LOC}, strand string").withColumn("tss_loc", loci.tss(F.col("loc"), F.col("strand")))
    p = frame(spark, [(10, ("chr1", 900, 1100)), (11, ("chr1", 6100, 6100)), (12, ("chr2", 1, 1))])
    near = {(r.rid, r.gid): r.dist_to_tss for r in intervals.annotate(g, p, distance_bp=200).collect()}
    assert near == {(10, 1): 0, (11, 2): -100}
    bands = {r.band: r["count"] for r in intervals.distribution(g.where("gid < 3"), p).collect()}
    assert bands == {"0 to 10": 1, "-10 to 0": 1, "desert": 1}
    assert intervals.annotate(g, p.limit(0)).count() == 0


def test_most_disjoint(spark):
    data = spans(5, 60, size=600)
    got = {r.rid for r in intervals.most_disjoint(frame(spark, data)).collect()}
    chosen = [l for i, l in data if i in got]
    assert not any(hit(x, y) for k, x in enumerate(chosen) for y in chosen[:k])
    best = 0
    for c in ("chr0", "chr1"):
        reach = -1
        for l in sorted((l for _, l in data if l[0] == c), key=lambda l: l[2]):
            if l[1] > reach:
                best, reach = best + 1, l[2]
    assert len(got) == best


def test_clusters_of_lists(spark):
    data = [(0, ("chr1", 100, 100), 0), (1, ("chr1", 900, 900), 1), (2, ("chr1", 5000, 5000), 1), (3, ("chr1", 1700, 1700), 0), (4, ("chr2", 1, 1), 0)]
    df = spark.createDataFrame(data, f"rid long, loc {LOC}, ix int")
    got = {(r.chrom, r.left, r.right, tuple(r.members), r.cid) for r in intervals.cluster_blocks(df, "ix", 2).collect()}
    assert got == {("chr1", -300, 2100, (1, 1), 3), ("chr1", 4600, 5400, (0, 1), 1), ("chr2", -399, 401, (1, 0), 2)}


def test_ordinals_and_running_totals(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"), (F.col("id") % 5).alias("v"))
    numbered = rows.with_ordinal(df, "n", ["k"]).orderBy("k").collect()
    assert [r.n for r in numbered] == list(range(2000))
    total = 0
    for r in stats.running_total(df, "v", ["k"], []).orderBy("k").collect():
        assert r._before == total
        total += r.v
    assert rows.with_ordinal(df.limit(0), "n", ["k"]).count() == 0


def test_rows(spark):
    df = spark.createDataFrame([(1, "a", 0, "x:1 y:2 junk"), (2, None, 5, "x:3:4"), (3, "", None, None), (4, "ab", 7, "")], "id long, t string, n int, kv string")
    assert [r.id for r in rows.remove_empty(df, "t").collect()] == [1, 4]
    assert [r.id for r in rows.remove_empty(df, "n").collect()] == [2, 4]
    assert {r.id: (r.x, r.y) for r in rows.split_pairs(df, "kv", ["x", "y"]).collect()} == {1: ("1", "2"), 2: ("3:4", None), 3: (None, None), 4: (None, None)}
    assert rows.pair_keys(df, "kv") == ["x", "y"]
    assert [r.id for r in rows.rows_by_pattern(df, ["a", "b"], "t").orderBy("id").collect()] == [1, 4, 4]
    assert [r.id for r in rows.filter_in(df, "t", "a").collect()] == [2, 3]
    assert [r.id for r in rows.get(df, "t", None).collect()] == [2]
    assert [r.id for r in rows.remove(df, "t", "a").collect()] == [2, 3, 4]
    assert rows.find_any(df, "7", ["id"]).first().id == 4 and rows.find_any(df, "none", ["id"]).count() == 0
    assert {r.id: r.t for r in rows.fill_from(df, "t", "kv").collect()} == {1: "a", 2: "x:3:4", 3: None, 4: "ab"}
    with pytest.raises(ValueError):
        rows.rename_key(df, "t", "n")
    assert rows.rename_key(df, "t", "n", replace=True).columns == ["id", "n", "kv"]
    same = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "t string, id long")
    assert sorted(r.t or "-" for r in rows.make_unique(same, "t", ["id"]).collect())[:3] == ["-", "a", "a_1"]
    assert {r.t: r.id for r in rows.distinct_on(same, ["t"], ["id"]).collect()} == {"a": 1, "b": 3, None: 4}
    assert rows.sample(same, 2, 5, ["id"]).collect() == rows.sample(same.repartition(3), 2, 5, ["id"]).collect()
    assert [r.id for r in rows.sort_by(same, ["t"], ["id"], reverse=True).collect()] == [3, 2, 1, 4]


def test_sets_and_key_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (9, "q")], "k long, v string")
    count = lambda df: sorted((r.k, r.v or "") for r in df.collect())
    assert count(sets.intersect(a, b)) == [(1, "x"), (1, "x"), (2, ""), (2, "")]
    assert count(sets.subtract(a, b)) == [(3, "z")]
    assert count(sets.union(a, b)) == [(1, "x"), (2, ""), (3, "z"), (9, "q")]
    assert sets.add(a, b.select("k")).count() == 8
    with pytest.raises(ValueError):
        sets.add(a, b.select(F.col("k").alias("other")))
    right = spark.createDataFrame([(1, "r", 5), (4, "s", 6)], "k long, v string, w int")
    got = keyjoin.map_join(a.withColumn("only", F.lit(1)), right, "k").collect()
    assert [(r.k, r.v, r.w, r.only) for r in got] == [(1, "r", 5, 1)] * 2
    assert keyjoin.map_join(a, right, "k", greedy=False, order=["v"]).count() == 1
    assert [r.k for r in keyjoin.map_join(a, right, "k", logic="notright").collect()] == [4]
    with pytest.raises(Exception):
        keyjoin.merge_tables([a.withColumn("conditions", F.array(F.lit(1.0)))] * 2, "k").collect()


def test_matrix_goldens(spark):
    df = spark.createDataFrame([("i1", [1.0, 2.0, 3.0, 4.0]), ("i2", [0.0, 0.0, 0.0, 0.0]), ("i3", [-5.0, 0.0, 5.0, 10.0])], "name string, conditions array<double>")
    names = list("abcd")
    x = np.array([r.conditions for r in df.collect()])
    value = lambda out: np.array([r.conditions for r in out.orderBy("name").collect()])
    assert np.allclose(value(mx.row_z(df))[0], (x[0] - x[0].mean()) / x[0].std()) and not value(mx.row_z(df))[1].any()
    assert np.allclose(value(mx.column_z(df, names)), (x - x.mean(0)) / x.std(0))
    assert np.allclose(value(mx.normalize(df)), (x - x.min()) / (x.max() - x.min()))
    assert np.allclose(value(mx.normalize_columns(df, names)), 1 - 2 * (x.max(0) - x) / (x.max(0) - x.min(0)))
    assert np.allclose(value(mx.abssub(df, 2))[2], [-3, 0, 3, 8])
    assert np.allclose(value(mx.whiten(df, names)), x / x.std(0))
    fc = {r.name: r.fc for r in mx.add_fold_change(df.where("name = 'i1'"), names, "a", "d").collect()}
    assert math.isclose(fc["i1"], 2, abs_tol=1e-5)
    out, kept = mx.mean_replicates(df, names, [["a", "c"]])
    assert kept == ["a", "b", "d"] and value(out)[0].tolist() == [2.0, 2.0, 4.0]
    assert np.allclose(out.orderBy("name").first().err, [1 / math.sqrt(2), 0, 0])
    q = value(mx.quantile_normalise(df, names, "name"))
    means, order = np.sort(x, axis=0).mean(axis=1), np.sort(x, axis=0)
    for c in range(x.shape[1]):  # equal values of a column get the median of the means of their ranks
        assert np.allclose(q[:, c], [np.median(means[order[:, c] == v]) for v in x[:, c]])
    assert mx.bundle(df, [("up", [1.0, 2.0, 3.0, 4.0])], "name").count() == 2


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, (40, 2)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rid long, conditions array<double>")
    names = ["a", "b"]
    rank = lambda v: np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])
    assert math.isclose(stats.spearmanr(df, names, "a", "b").first().r, np.corrcoef(rank(x[:, 0]), rank(x[:, 1]))[0, 1])
    pooled = rank(x.ravel(order="F"))
    assert math.isclose(stats.mannwhitney(df, names, "a", "b").first().u, pooled[:40].sum() - 40 * 41 / 2)
    d = x[:, 0] - x[:, 1]
    d = d[d != 0]
    r = rank(np.abs(d))
    assert math.isclose(stats.wilcoxon(df, names, "a", "b").first().w, min(r[d > 0].sum(), r[d < 0].sum()))
    t, p = stats.ttest_p(df, names, "a", "b")
    v1, v2 = x.var(axis=0, ddof=1) / 40
    assert math.isclose(t, (x[:, 0].mean() - x[:, 1].mean()) / math.sqrt(v1 + v2)) and 0 < p < 1
    seq = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "k long, v double")
    v = [float(i % 7) for i in range(50)]
    assert {r.x: r.y for r in stats.sliding_sum(seq, "v", ["k"], 6).collect()} == {n: sum(v[n - 3 : n + 3]) for n in range(3, 47)}
    assert {r.k: round(r.mean, 9) for r in stats.running_mean(seq, "v", ["k"], 5).collect()} == {n: round(sum(v[n - 4 : n + 1]) / 5, 9) for n in range(5, 50)}


def test_distribution_functions():
    assert math.isclose(beta_inc(2, 3, 0.4), 0.5248, rel_tol=1e-9)
    assert math.isclose(t_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(chi2_upper(3.84145882069412, 1), 0.05, rel_tol=1e-9) and math.isclose(chi2_upper(20, 4), 0.000499399227, rel_tol=1e-6)


@pytest.mark.parametrize("bits", [3, 20])
def test_depth_matches_brute_force(spark, bits):
    rng = random.Random(bits)
    data = [("c", l := rng.randrange(200), l + rng.randrange(20), rng.choice([1.0, 0.5])) for _ in range(80)] + [("d", 5, 5, 1.0), (None, 1, 3, 1.0)]
    df = spark.createDataFrame(data, "chrom string, start long, end long, w double")
    dense = {}
    for c, l, r, w in data:
        if c:
            for p in range(l, r):
                dense[c, p] = dense.get((c, p), 0) + w
    got = {}
    for r in depth_runs(df.where("chrom is not null"), ["chrom"], "start", "end", "w", block_bits=bits).collect():
        for p in range(r.start, r.end):
            assert (r.chrom, p) not in got
            got[r.chrom, p] = r.value
    assert got == pytest.approx(dense)


def test_track_profiles(spark):
    dense = list(range(100)) + [0] * 400
    runs = spark.createDataFrame([("chr1", i, i + 1, float(v)) for i, v in enumerate(dense) if v], "chrom string, start long, end long, value double")
    assert tracks.to_array(runs, "chr1", 10, 20).first()[0] == [float(v) for v in range(10, 20)]
    one = spark.createDataFrame([(1, ("chr1", 15, 15), "+")], f"rid long, loc {LOC}, strand string")
    assert [r.value for r in tracks.pileup(runs, one, window=15).orderBy("offset").collect()] == list(map(float, range(30)))
    two = one.unionByName(spark.createDataFrame([(2, ("chr1", 15, 15), "-")], one.schema))
    assert [r.value for r in tracks.pileup(runs, two, window=15).orderBy("offset").collect()] == [14.5] * 30
    assert tracks.density(runs, one, expand_by=5).first().value == sum(range(10, 20))
    e = tracks.enrichment(runs, one.withColumn("loc", loci.loc(F.lit("chr1"), F.lit(50), F.lit(50))), peak_window=10, local=40).first()
    flank = np.array(dense[10:40] + dense[60:90])
    assert math.isclose(e.peak, 59) and math.isclose(e.mean, flank.mean()) and math.isclose(e.z, (59 - flank.mean()) / flank.std())


def test_motifs(spark):
    assert to_regex("RNA") == "[AG][ACGT]A" and rc_word("ARN") == "NYT" and len(expand_word("RN")) == 8 and mismatch_regexes("AC") == ["[ACGT]C", "A[ACGT]"]
    df = spark.createDataFrame([(1, "AACGTTaacg"), (2, ""), (3, None), (4, "AC")], "rid long, seq string")
    got = {(r.rid, r.pos, r.strand) for r in motif_positions(df, "AACG", key="rid").collect()}
    assert got == {(1, 0, "+"), (1, 6, "+"), (1, 2, "-")}
    w = counts_to_weights([[9, 1, 1, 1], [1, 9, 1, 1]])
    f, b = window_scores("ACNGT", np.array(w))
    assert math.isclose(f[0], 1) and math.isclose(b[3], 1) and f[1] == 0 == b[2]
    assert {(r.rid, r.pos, r.strand) for r in pwm_hits(df, w, key="rid", threshold=0.99).collect()} == {(1, 1, "+"), (1, 3, "-"), (1, 7, "+"), (4, 0, "+")}


def test_trees_and_maps():
    x = np.array([[0, 0], [0, 1], [5, 5], [5, 6.5], [20, 20]], float)
    for method in ("complete", "single", "average", "ward"):
        m = learn.linkage(x, method)
        assert learn.cut_tree(m, 5, 3).tolist() == [0, 0, 1, 1, 2] and sorted(learn.leaf_order(m, 5)) == list(range(5))
    y = learn.mds(x)
    d = lambda p: np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.allclose(d(x), d(y))
    blobs = np.concatenate([np.random.default_rng(0).normal(c, 0.1, (15, 3)) for c in (0, 5)])
    z = learn.tsne(blobs, perplexity=5, rounds=300)
    assert d(z)[:15, :15].mean() < d(z)[:15, 15:].mean()
    assert learn.spanning_tree([("a", "b", 1), ("b", "c", 2), ("a", "c", 3)]) == [("a", "b", 1), ("b", "c", 2)]
    assert learn.longest_path([("a", "b"), ("b", "c"), ("c", "d"), ("b", "e")])[-1] in "ae"
    assert len(set(learn.graph_clusters([("a", "b", 0.9), ("b", "c", 0.1)], ["a", "b", "c"], 2).values())) == 2


def test_driver_side_methods_check_their_size(spark):
    big = spark.range(learn.MOST_POINTS + 5).select("id", F.array(F.lit(1.0)).alias("conditions"))
    with pytest.raises(ValueError):
        learn.tree(big, "id")
