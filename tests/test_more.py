"""Feature store, motif files, read quality, graphs, arrays and the entry point."""

import math

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions import arrays
from loomspan.operators import contacts, learn, massspec, motifs, readqc, stats, tracks
from loomspan.operators import matrix as mx
from loomspan.sources import motif_files, store

LOC = "struct<chrom: string, left: bigint, right: bigint>"


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(("chr1", 110, 120), ("chr1", 112, 118), [110], [120], "Nanog", "+", "gene"), (("chr2", 5, 9), None, [5, 7], [6, 9], "Pou5f1", "r", "gene")]
    df = spark.createDataFrame(rows, f"loc {LOC}, cds_loc {LOC}, exon_starts array<int>, exon_ends array<int>, name string, strand string, feature_type string")
    store.add_features(df, path)
    store.add_features(df.limit(0), path)
    s = store.open_store(spark, path)
    assert [store.features_at(s, "chr1", l, r).count() for l, r in ((100, 110), (120, 130), (121, 130), (100, 109))] == [1, 1, 0, 0]
    assert {r.chrom: r.num_features for r in store.chromosomes(s).collect()} == {"chr1": 1, "chr2": 1}
    assert store.find(s, "Pou5f1").first().strand == "-"


def test_motif_files(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    j = motif_files.read_jaspar(spark, put("j", ">M1 One\n1 2\n3 4\n5 6\n7 8\n>M2\n[ 1 1 ]\n2 2\n3 3\n4 4\n")).orderBy("id").collect()
    assert [(r.id, r.name, r.matrix) for r in j] == [("M1", "One", [[1, 3, 5, 7], [2, 4, 6, 8]]), ("M2", "M2", [[1, 2, 3, 4]] * 2)]
    a = motif_files.read_acgt_rows(spark, put("a", "first\nA: 1 2\nC: 3 4\nG: 5 6\nT: 7 8\n\nsecond\nA 0.5\nC 0.5\nG 0\nT 0\n")).orderBy("name").collect()
    assert [(r.name, r.matrix) for r in a] == [("first", [[1, 3, 5, 7], [2, 4, 6, 8]]), ("second", [[0.5, 0.5, 0, 0]])]
    t = motif_files.read_transfac(spark, put("t", "ID X1\nNA Name\nP0 A C G T\n01 1 2 3 4 N\n02 5 6 7 8 N\nXX\n//\n")).collect()
    assert [(r.id, r.name, r.matrix) for r in t] == [("X1", "Name", [[1, 2, 3, 4], [5, 6, 7, 8]])]
    assert motif_files.read_aligned_words(spark, put("w", "ACG\nACT\n")).first().matrix == [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 1, 1]]
    h = motif_files.read_homer_motifs(spark, put("h", ">ACG\tn1\t5.5\t-1\n0.1\t0.2\t0.3\t0.4\n1\t0\t0\t0\n")).first()
    assert (h.word, h.name, h.score, h.matrix) == ("ACG", "n1", 5.5, [[0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0]])


def test_read_quality(spark):
    df = spark.createDataFrame([("AC", [10, 20]), ("AG", [30, 20]), ("AC", [20])], "seq string, qual array<int>")
    assert {r.pos: (r["mean"], r.reads) for r in readqc.quality_by_position(df).collect()} == {0: (20, 3), 1: (20, 2)}
    assert {(r.pos, r.base): r["count"] for r in readqc.bases_by_position(df).collect()} == {(0, "A"): 3, (1, "C"): 2, (1, "G"): 1}
    assert {r.copies: r.sequences for r in readqc.duplicates(df, most=2).collect()} == {1: 1, 2: 1}


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],)], "v array<double>")
    r = df.select(arrays.bin_sums(F.col("v"), 2).alias("s"), arrays.bin_means(F.col("v"), 2).alias("m"), arrays.index_where(F.col("v"), lambda x: x > 2).alias("i")).collect()
    assert (r[0].s, r[0].m, r[0].i) == ([3, 7, 5], [1.5, 3.5, 5], 2) and (r[1].s, r[1].i) == ([], -1)
    assert df.limit(1).select(arrays.rescale(F.col("v"), 2)).first()[0] == [1.5, 4.0]


def test_graphs(spark):
    edges = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("b", "x", 0.6), ("x", "y", 0.5)]
    path = learn.longest_path(edges)
    assert len(path) == 4 or len(path) == 5
    b = learn.branches(edges)
    assert set(b) == set("abcdxy") and all(b[n] == 0 for n in path)
    assert learn.path_neighbours(edges, ["a"], 2) == {"a", "b", "c", "x"}
    assert learn.rooted_edges(edges, "b", 0.6, 2) == [("b", "a", 0.9), ("b", "c", 0.8), ("c", "d", 0.7)]
    df = spark.createDataFrame([("p", [1.0, 2.0, 3.0]), ("q", [2.0, 4.0, 6.1]), ("r", [3.0, 2.0, 1.0])], "k string, conditions array<double>")
    assert [e[:2] for e in learn.correlated_edges(df, "k", low=0.5)] == [("p", "q")]
    heat = learn.heat_payload(df, "k", ["a", "b", "c"]).collect()
    assert len(heat) == 9 and {r.row_order for r in heat} == {0, 1, 2}


def test_som_and_projection(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 2), 0.1, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "rid long, conditions array<double>")
    nodes, code = learn.som(df, "rid", 2, 2, epochs=5)
    at = {r.rid: r.node for r in nodes.collect()}
    assert not {at[i] for i in range(0, 60, 2)} & {at[i] for i in range(1, 60, 2)}
    near = learn.project(df, "rid", code, 2)
    value = {r.rid: r.value for r in learn.node_values(code, 0, learn.project(df, "rid", code), "rid").collect()}
    assert abs(value[0]) < 4 and abs(value[1] - 10) < 4
    assert {r.positive for r in learn.sign_shares(code, 0, near, "rid").collect()} <= {0.0, 0.5, 1.0} and learn.strong_nodes(code, 0)


def test_adjusted_p(spark):
    ps = [0.01, 0.04, 0.03, 0.2, None]
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    got = {r.k: r.q for r in stats.adjust(df, "p", "k").collect()}
    assert all(math.isclose(got[k], q) for k, q in {0: 0.04, 1: 0.16 / 3, 2: 0.16 / 3, 3: 0.2}.items()) and got[4] is None
    m = spark.createDataFrame([(i, [float(i % 5), float(i % 5 + 3), float(i % 5)]) for i in range(40)], "rid long, conditions array<double>")
    out = stats.tests_against(m, ["a", "b", "c"], "a")
    assert out[0][1] == 1.0 and out[1][2] < 0.001 and out[2][1] > 0.99


def test_track_lists(spark):
    runs = spark.createDataFrame([("t1", "chr1", 90, 110, 2.0), ("t2", "chr1", 95, 100, 1.0)], "track string, chrom string, start long, end long, value double")
    peaks = spark.createDataFrame([(1, ("chr1", 100, 100))], f"rid long, loc {LOC}")
    got = {(r.track, r.bin): r.value for r in tracks.list_heat(runs, "track", peaks, distance=20, bins=4).collect()}
    assert got == {("t1", 1): 20.0, ("t1", 2): 20.0, ("t2", 1): 5.0}
    pieces = spark.createDataFrame([(1, "c", 0, 10, 1.0), (2, "c", 5, 8, 7.0), (3, "c", 20, 20, 9.0)], "rid long, chrom string, left long, right long, score double")
    flat = sorted((r.start, r.end, r.value) for r in tracks.assign(pieces).collect())
    assert flat == [(0, 5, 1.0), (5, 8, 7.0), (8, 10, 1.0)]


def test_contacts_and_massspec(spark):
    bins = spark.createDataFrame([(0, "a", 0, 10), (1, "a", 10, 20), (2, "b", 0, 10)], "bin_id long, chrom string, left long, right long")
    pixels = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (0, 2, 9.0)], "bin1 long, bin2 long, score double")
    c = contacts.load_triplets(pixels, bins)
    assert {(r.chrom, r.i, r.j): r.score for r in c.collect()} == {("a", 0, 1): 2.0, ("a", 1, 1): 3.0}
    assert [r["values"] for r in contacts.dense_rows(c, "a", 2).orderBy("i").collect()] == [[0, 2], [2, 3]]
    wide = spark.createDataFrame([("A;B", "1;2", "2e6", "3"), ("C", "4", "0", "1"), (None, None, "1", "1")], "name string, pid string, `Intensity s1` string, `Razor + unique peptides s1` string")
    long = massspec.melt(wide, ["s1"])
    assert {(r.name, r.pid, r.intensity) for r in long.collect()} == {("A", "1", 2.0), ("B", "2", 2.0), ("C", "4", 0.0)}
    assert {r.name: r.intensity for r in massspec.to_arrays(long, ["s1", "s2"]).collect()}["A"] == [2.0, None]
    sheet = spark.createDataFrame([(["S01-A01", "x", "", "", "g1", "", "22.5", "", "Pass"],), (["header"],)], "cells array<string>")
    assert [tuple(r) for r in massspec.biomark_cycles(sheet, prefix="p_").collect()] == [("p_x", "g1", 22.5, True)]
    hits = motifs.motif_set_hits(spark.createDataFrame([(1, "T" * 60 + "ACGACG" + "T" * 60)], "rid long, seq string"), {"m": motifs.counts_to_weights([[9, 1, 1, 1], [1, 9, 1, 1], [1, 1, 9, 1]] * 2)}, key="rid")
    assert {(r.motif, r.pos, r.strand) for r in hits.collect()} == {("m", 60, "+")}
    assert mx.insert_condition(spark.createDataFrame([(1, [1.0])], "k int, conditions array<double>"), "k", spark.createDataFrame([(1, 5.0)], "k int, v double"), "v").first().conditions == [1.0, 5.0]


def test_entry_point(spark, data):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "overlap_and" in names
    assert entry.entry(spark).columns == ["src", "name", "chrom", "kind", "lo", "hi"]
