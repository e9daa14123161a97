"""Intervals in blocks, readers, stored tracks, vectorised scans and graph helpers against brute force."""

import bisect
import gzip
import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions.loci import loc
from loomspan.operators import contacts, intervals, learn, massspec, motifs, sets, stats, tracks
from loomspan.session import laid_out
from loomspan.sources import bam, readers, store
from loomspan.sources.formats import Format
from loomspan.sources.rejects import parse_lines

SPAN = "rid long, chrom string, l long, r long"


def spans(spark, rows):
    df = spark.createDataFrame(rows, SPAN)
    return df.select("rid", loc(F.col("chrom"), F.col("l"), F.col("r")).alias("loc"), F.lit(1).alias("id"), F.lit(2).alias("block")).repartition(5)


def some_spans(seed, n=300, reach=3000, longest=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        l = rng.randrange(-200, reach)
        rows.append((i, rng.choice(["a", "a", "b"]), l, l + rng.choice([0, 5, 20, longest])))
    rows += [(n + k, *rows[k * 7 % n][1:]) for k in range(20)]  # the same interval again
    rng.shuffle(rows)
    return rows


def greedy(rows):
    kept = []
    for i, c, l, r in sorted(rows):
        if not any(c == k[1] and l <= k[3] and r >= k[2] for k in kept):
            kept.append((i, c, l, r))
    return {k[0] for k in kept}


# --- intervals in blocks -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [40, 333, 1 << 24])
def test_dedupe_in_blocks(spark, size):
    rows = some_spans(size)
    df = spans(spark, rows + [(900, None, 1, 2)]).withColumn("loc", F.when(F.col("rid") < 900, F.col("loc")))
    got = {r.rid for r in intervals.dedupe_by_loc(df, mode="overlap", bin_size=size).collect()}
    assert got == greedy(rows) | {900}


@pytest.mark.parametrize("size", [1000, 1 << 24])
def test_dedupe_of_a_sorted_chain(spark, size):
    """Every row overlaps the one before it: one long dependency."""
    rows = [(i, "a", 300 * i, 300 * i) for i in range(200)]
    got = {r.rid for r in intervals.dedupe_by_loc(spans(spark, rows), delta=200, bin_size=size).collect()}
    assert got == set(range(0, 200, 2))


@pytest.mark.parametrize("bits", [4, 9, 24])
def test_most_disjoint_in_blocks(spark, bits):
    rows = some_spans(bits)
    want = set()
    for c in "ab":
        reach = -math.inf
        for i, _, l, r in sorted((x for x in rows if x[1] == c), key=lambda x: (x[3], x[3] - x[2], x[0])):
            if l > reach:
                want.add(i)
                reach = r
    df = spans(spark, [*rows, (990, "a", 9, 3), (991, None, 1, 2)])
    assert {r.rid for r in intervals.most_disjoint(df, block_bits=bits).collect()} == want
    assert intervals.most_disjoint(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 12, 10_000])
def test_rows_that_overlap_nothing(spark, bits):
    a, b = some_spans(1, 120), some_spans(2, 60, longest=400)
    odd = [(1001, "a", 9, 3), (1002, None, 1, 2), (1003, "c", 1, 2)]
    got = intervals.without(spans(spark, a + odd), spans(spark, b + [(5, "a", 7, 2)]), lambda l: l, bin_size=bits)  # rows of several bin sizes
    want = {i for i, c, l, r in a if not any(c == k[1] and l <= k[3] and r >= k[2] for k in b)} | {1001, 1002, 1003}
    assert sorted(r.rid for r in got.collect()) == sorted(want) and got.columns == spans(spark, a).columns
    assert intervals.without(spans(spark, a), spans(spark, b).limit(0), lambda l: l).count() == len(a)
    assert intervals.without(spans(spark, a).limit(0), spans(spark, b), lambda l: l).count() == 0


def test_layout_is_known_to_later_plans(spark):
    df = laid_out(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"), "k")
    plan = df.groupBy("k").agg(F.count("*").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.conf.get("spark.sql.adaptive.enabled") == "true"


# --- readers -----------------------------------------------------------------------------------------


def test_lines_are_numbered_by_file(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name, n in (("a.txt", 700), ("b.txt", 3), ("c.txt", 900)):
        lines = ["x" * rng.randrange(0, 40) + str(i) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "b.txt" else ""))
        want[name] = lines
    (tmp_path / "empty.txt").write_text("")
    with gzip.open(tmp_path / "d.txt.gz", "wt") as out:
        out.write("one\r\ntwo\r\n")
    (tmp_path / "mac.txt").write_text("p\rq\rr")
    want |= {"d.txt.gz": ["one", "two"], "mac.txt": ["p", "q", "r"]}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {}
        for r in readers.numbered_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.ordinal] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {f: [x[i] for i in range(len(x))] for f, x in got.items()} == want


def test_unnumbered_reading_is_one_narrow_pass(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1\t5\t9\tn\t1\t+\nchrX\t7\t8\tm\t2\t-\n")
    df = readers.read_table(spark, str(tmp_path), "bed", infer=False, numbered=False)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.loc.chrom, r.loc.left, r.name) for r in df.collect()} == {("chr1", 5, "n"), ("chrX", 7, "m")}


def test_error_columns(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("name\tmean_a\terr_a\tmean_b\terr_b\ng\t1\t0.5\tNA\t0.25\nh\t3\n")
    df, names = readers.read_expression(spark, str(tmp_path), {"name": 0}, 1, errors="interleaved", nan_value=-1)
    assert names == ["a", "b"]
    assert [(r.name, r.conditions, r.err) for r in df.orderBy("name").collect()] == [("g", [1.0, -1.0], [0.5, 0.25]), ("h", [3.0, -1.0], [-1.0, -1.0])]


def test_values_the_reader_converts_otherwise(spark):
    """What the reader's own conversions take or leave otherwise than they should."""
    nb = chr(0xA0)
    bed = {"chr1\t1.5\t9\tn\t1\t+": "loc", "chr1\t1e3\t2000\tn\t1\t+": "loc", "chr1\t-5\t9\tn\t1\t+": "loc", f"chr1\t{nb}5 \t9\tn\t1{nb}\t+": None, "chr1\t5\t9\tn\tinf\t+": "score", "chr1\t5\t9\tn\tnan\t+": "score", "chr1\t5\t9\tn\t0x1F\t+": "score",
           "chr1\t5\t9\tn\t1_0\t+": "score", "chr1\t5\t9\tn\t1e2\t+": None, "chr1\t5\t9\tn\t1000.1\t+": "score", "chr1\tx\t9\tn\ty\t*\tz": "column_count", "chr1\tx\t9\tn\ty\t*": "loc", "chr1\t5\t9\tn\t\t*": "score", "chr1\t5\t9\tn\t.5\t *": "strand", "chr1\t5\t9\tn\t5.\t -1 ": None, "chr 1\t5\t9\tn\t1\t+": "loc"}
    csv = {'"chr1:1,000-2,000",n,1,+': None, 'chr1:5-9,"a ""b"", c", 1e1 ," f "': None, 'chr1:5-9,n,"1",+': None, "chr1:9-5,n,1,+": "loc", "chr1:5-9,n,,+": "score", "chr1:5-9,n,1,x": "strand", 'chr1:5-9,n"q,1,+': "quoting", "chr1:5-9,n,1": "column_count", 'chr1:5-9,"n,1,+': "quoting"}
    rows = [(k, "bed", x, w) for k, (x, w) in enumerate(bed.items())] + [(100 + k, "csv", x, w) for k, (x, w) in enumerate(csv.items())]
    got = {r.rec_id: r for r in parse_lines(spark.createDataFrame([r[:3] for r in rows], "rec_id long, fmt string, line string")).collect()}
    assert {k: r.reason for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert (got[3].left, got[3].score) == (5, 1.0) and (got[101].name, got[101].score, got[101].strand) == ('a "b", c', 10.0, "f") and (got[100].left, got[100].right) == (1000, 2000)


def bam_bytes(reads, chroms=("chr1", "chr2")):
    text = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(chroms))
    for c in chroms:
        out += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 10_000)
    for name, flag, ref, pos, mapq, cigar, template, seq in reads:
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        packed = [("=ACMGRSVTWYHKDBN".index(b)) for b in seq]
        packed += [0] * (len(packed) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, template) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2])) + b"\xff" * len(seq)
        out += struct.pack("<i", len(body)) + body
    return b"".join(gzip.compress(out[i : i + 97]) for i in range(0, len(out), 97))  # a record spans members


def test_binary_alignments(spark, tmp_path):
    reads = [("r1", 99, 0, 10, 60, "3M1I2M2D4M", 100, "ACGTNACGTA"), ("r1", 147, 0, 90, 60, "10M", -100, "ACGTACGTAC"), ("r2", 4, -1, -1, 0, "", 0, "ACG"), ("r3", 16, 1, 5, 7, "2S3M", 0, "GGTTT")]
    (tmp_path / "x.bam").write_bytes(bam_bytes(reads))
    (tmp_path / "y.bam").write_bytes(bam_bytes([]))
    df = bam.read_bam(spark, f"{tmp_path}/*.bam", rows=2)
    got = {(r.qname, r.flag): r for r in df.collect()}
    assert len(got) == 4 and (got["r1", 99].left, got["r1", 99].right, got["r1", 99].seq, got["r1", 99].cigar) == (10, 21, "ACGTNACGTA", "3M1I2M2D4M")
    assert got["r2", 4].chrom is None and (got["r3", 16].strand, got["r3", 16].chrom, got["r3", 16].right) == ("-", "chr2", 8)
    assert [tuple(r) for r in bam.fragments(df).collect()] == [("chr1", 10, 110)]


def test_vendor_tables(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Protein accession\tx\tname\tIntensity s 1\tRazor + unique peptides s 1\tIntensity s2\tRazor + unique peptides s2\nP1\t-\tgene\t2000000\t3\t\t\nP2\t-\t\t1\t1\t1\t1\nP3\t-\tother\t1000000\t2.0\n")
    got = {(r.name, r["sample"]): (r.pid, r.intensity, r.peptides) for r in massspec.read_company(spark, str(tmp_path / "c.txt")).collect()}
    assert got == {("gene", "s 1"): ("P1", 2.0, 3.0), ("gene", "s2"): ("P1", 0.0, 0.0), ("other", "s 1"): ("P3", 1.0, 2.0), ("other", "s2"): ("P3", 0.0, 0.0)}
    for name, value in (("one.txt", 4_000_000), ("two.tsv", 6_000_000)):
        (tmp_path / name).write_text("Accession\t" + "\t".join("abcdefghi") + f"\nP1\t-\tg\t-\t-\t-\t5.0\t-\t-\t{value}\nP9\t-\tshort\n")
    rows = massspec.read_company_samples(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.tsv")]).collect()
    assert {(r.name, r["sample"], r.intensity, r.peptides) for r in rows} == {("g", "one", 4.0, 5.0), ("g", "two", 6.0, 5.0), ("short", "one", 0.0, 0.0), ("short", "two", 0.0, 0.0)}


def test_feature_store_lookups(spark, tmp_path):
    rows = spark.createDataFrame([("chr1", 5, 9, "n", "gene"), ("chr2", 1, 2, "m", "exon")], "chrom string, l long, r long, name string, feature_type string")
    place = loc(F.col("chrom"), F.col("l"), F.col("r"))
    path = str(tmp_path / "s")
    features = rows.select(place.alias("loc"), place.alias("cds_loc"), F.array("l").alias("exon_starts"), F.array("r").alias("exon_ends"), "name", F.lit("1").alias("strand"), "feature_type")
    store.add_features(features, path)
    opened = store.open_store(spark, path)
    assert store.has_chromosome(opened, "1") and store.has_chromosome(opened, "chr2") and not store.has_chromosome(opened, "chr11")
    assert store.by_feature(opened, "exon").first().name == "m" and store.by_key(opened, "name", "n").first().strand == "+"
    with pytest.raises(ValueError):
        store.by_key(opened, "nothing", 1)
    assert store.read_info(spark, path) == {}
    store.write_info(spark, path, version=1)
    store.write_info(spark, path, version=2, source="x")
    assert store.read_info(spark, path) == {"version": "2", "source": "x"} and store.open_store(spark, path).count() == 2


def test_go_lists(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("name\tq\nGO~7\t0.1\n")
    assert readers.read_go(spark, str(tmp_path), Format(keys={"name": "0", "qvalue": "1"}, tsv=True)).first().name == "GO:7"
    with pytest.raises(ValueError):
        readers.read_go(spark, str(tmp_path), Format(keys={"name": "0"}, tsv=True))


# --- tracks and contacts -----------------------------------------------------------------------------


def test_stored_track(spark, tmp_path):
    track = spark.createDataFrame([("a", 0, 5, 2.0), ("a", 9, 12, 1.0), ("b", 3, 4, 7.0)], "chrom string, start long, end long, value double")
    tracks.save_track(track, str(tmp_path / "t"), total_reads=2_000_000, name="x")
    back, info = tracks.open_track(spark, str(tmp_path / "t"))
    assert info == {"total_reads": 2_000_000, "name": "x", "chromosomes": {"a": 12, "b": 4}}
    assert sorted(map(tuple, back.select("chrom", "start", "end", "value").collect())) == sorted(map(tuple, track.collect()))
    assert tracks.per_million(back, 2_000_000).agg(F.max("value")).first()[0] == 3.5


def test_cluster_pileup(spark):
    track = spark.createDataFrame([("a", 0, 8, 2.0), ("a", 14, 30, 1.0)], "chrom string, start long, end long, value double")
    blocks = spark.createDataFrame([("a", 8, 12, 1), ("a", 18, 22, 1), ("b", 5, 7, 2)], "chrom string, left long, right long, cid int")
    depth = lambda p: 2.0 if 0 <= p < 8 else 1.0 if 14 <= p < 30 else 0.0
    got = {(r.cid, r.offset): r.value for r in tracks.cluster_pileup(track, blocks, window=5).collect()}
    assert got == {(1, o): (depth(10 + o) + depth(20 + o)) / 2 for o in range(-5, 5) if depth(10 + o) + depth(20 + o)}


def test_components_of_contacts(spark):
    rows = [("a", i, j, float(1 + (i % 3 == j % 3) * 9)) for i in range(9) for j in range(i, 9)]
    c = spark.createDataFrame(rows, "chrom string, i long, j long, score double")
    scores, percent = contacts.components_of(c, "a", 9, 2)
    assert scores.count() == 9 and percent[0] >= percent[1] > 0 and sum(percent) <= 100.000001
    assert contacts.embed_bins(c, "a", 9, method="mds").count() == 9
    assert len(contacts.compartments(c, "a", 9)) == 9


# --- sequences ---------------------------------------------------------------------------------------


def test_motif_scans_match_plain_search(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGTacgtN", k=rng.randrange(0, 60))) for _ in range(60)] + ["é" + "ACGA", None, ""]
    df = spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string")
    got = {(r.rid, r.pos, r.strand, r.match) for r in motifs.motif_positions(df, "RCG", key="rid").collect()}
    want = set()
    for i, s in enumerate(seqs):
        for sign, pattern in (("+", "(?=([AG]CG))"), ("-", "(?=(CG[CT]))")):
            want |= {(i, m.start(), sign, m[1]) for m in re.finditer(pattern, (s or "").upper())}
    assert got == want
    for k in (3, 40):
        counts = {}
        for s in seqs:
            for p in range(len(s or "") - k + 1):
                counts[s[p : p + k]] = counts.get(s[p : p + k], 0) + 1
        assert {r.kmer: r["count"] for r in motifs.kmer_counts(df, k).collect()} == counts
    weights = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0.5]]
    hits = {(r.rid, r.pos, r.strand): r.score for r in motifs.pwm_hits(df, weights, key="rid", threshold=-1).collect()}
    best = {}
    for (i, _, _), s in hits.items():
        best[i] = max(best.get(i, -9), s)
    assert {r.rid: r.score for r in motifs.best_score(df, weights, key="rid").collect()} == pytest.approx(best)
    rates = {round(r.threshold, 6): r.hits for r in motifs.error_rate(df, weights, first=0.5, step=0.25, steps=3).collect()}
    assert rates == {t: sum(s >= t for s in hits.values()) for t in (0.5, 0.75, 1.0)}
    each = {}
    for (i, p, sign), s in hits.items():
        each.setdefault(i, []).append((s, p, sign))
    far = {(i, p, sign) for i, v in each.items() for s, p, sign in v if np.std([x[0] for x in v]) > 0 and (s - np.mean([x[0] for x in v])) / np.std([x[0] for x in v]) > 1.5}
    assert {(r.rid, r.pos, r.strand) for r in motifs.motif_set_hits(df, {"m": weights}, key="rid", z=1.5).collect()} == far
    assert motifs.error_rate(df.limit(0), weights).agg(F.sum("hits")).first()[0] == 0


def test_periodicity(spark):
    df = spark.createDataFrame([(1, "AACGTTAAC"), (2, "GGAAC"), (3, None), (4, "")], "rid long, seq string")
    got = {(r.window, r.pos): (r.hits, r.mean) for r in motifs.periodicity(df, "AAC", windows=[2]).collect()}
    starts = {}
    for s in ("AACGTTAAC", "GGAAC"):
        for t in (s, s.translate(str.maketrans("ACGT", "TGCA"))[::-1]):
            for m in re.finditer("AAC", t):
                starts[m.start()] = starts.get(m.start(), 0) + 1
    assert got == {(2, p): (starts.get(p, 0), (starts.get(p, 0) + starts.get(p + 1, 0)) / 2) for p in range(8)}


def test_matrix_of_aligned_words(spark):
    df = spark.createDataFrame([("ACG",), ("ACT",), ("aNG",), (None,)], "seq string")
    assert motifs.count_matrix(df) == [[3, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 1]]
    assert motifs.count_matrix(df.limit(0)) == []


# --- sets, statistics, learning ----------------------------------------------------------------------


def test_pairs_of_many_lists(spark):
    rng = random.Random(4)
    lists = [f"l{i}" for i in range(70)]
    rows = [(n, k) for n in lists[:-1] for k in rng.sample(range(40), rng.randrange(1, 12))] + [("l0", None), ("other", 3)]
    df = spark.createDataFrame(rows, "name string, key long")
    have = {n: {k for m, k in rows if m == n and k is not None} for n in lists}
    got = {(r.a, r.b): (r.hits, r.score) for r in sets.pairwise(df, "name", "key", lists).collect()}
    assert len(got) == 70 * 69 // 2
    for a, b in itertools.combinations(lists, 2):
        hits, small = len(have[a] & have[b]), min(len(have[a]), len(have[b]))
        assert got[a, b] == (hits, pytest.approx(max(hits, 1) / small) if small else None)


def test_adjusted_p_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    p = rng.random(3000).round(3)
    got = dict(stats.adjust(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "k long, p double"), "p", "k").select("k", "q").collect())
    order = np.lexsort((np.arange(len(p)), p))
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(max=1)
    assert np.allclose([got[int(i)] for i in order], q)


def test_maps_keep_groups_apart():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (40, 6)) for c in (0, 4, 8)])
    group = np.repeat(np.arange(3), 40)
    for out in (learn.umap(x, rounds=150), learn.mds(x)):
        d = ((out[:, None] - out[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        assert (group[d.argmin(axis=1)] == group).mean() > 0.98
    assert learn.umap(x[:1]).shape == (1, 2)


def test_threshold_clusters_and_branches():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    got = learn.threshold_clusters(x, list("abcde"), 3)
    assert got["a"] == got["b"] and got["c"] == got["d"] and len(set(got.values())) == 3
    spine = [(i, i + 1) for i in range(8)]
    twig = [(4, 20), (20, 21), (21, 22)]
    paths = learn.branch_paths(spine + twig + [(2, 30)], 2)
    assert set(paths[0]) == set(range(9)) and [sorted(p) for p in paths[1:]] == [[20, 21, 22]]


def test_normalise_and_back():
    x = np.array([[1.0, 5.0], [3.0, 5.0]])
    for method in ("var", "range"):
        y, shift, scale = learn.normalise(x, method)
        assert np.allclose(learn.denormalise(y, shift, scale), x) and np.allclose(y[:, 1], 0)


def test_tree_over_conditions(spark):
    df = spark.createDataFrame([(i, [float(i), i + 0.1, 50.0 - i]) for i in range(20)], "rid long, conditions array<double>")
    order, merges, groups = learn.column_tree(df, ["a", "b", "c"], clusters=2)
    assert sorted(order) == ["a", "b", "c"] and merges[0, 2] == pytest.approx(math.sqrt(20 * 0.01), rel=1e-6)
    named = dict(zip(order, groups))
    assert named["a"] == named["b"] != named["c"] and bisect.bisect([1], 1) == 1
