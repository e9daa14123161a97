"""Training-data operators against brute force, round trips and planted cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.llm.leakage import ItemIndex, Words, find_leaks, leaks_in, myers_prefix, plain
from loomspan.llm.overlap_sizes import overlap_sizes, pair_counts
from loomspan.llm.packing import fill_containers, plan_containers, token_lengths
from loomspan.llm.profile_clusters import correlations, describe_clusters, open_links, paired, profile_clusters
from loomspan.llm.quantiles import RankSketch, combine, percentiles, summaries
from loomspan.llm.subject_areas import Sentences, subject_shares

# --- overlap sizes ----------------------------------------------------------------------------------


@pytest.mark.parametrize("heavy", [0, 2, 100])
def test_pair_counts_match_brute_force(heavy):
    rng = random.Random(heavy)
    rows = [sorted(rng.sample(range(30), rng.choice([1, 2, 3, 12, 25]))) for _ in range(200)] + [[]]
    want = {}
    for r in rows:
        for a, b in itertools.combinations_with_replacement(r, 2):
            want[a, b] = want.get((a, b), 0) + 1
    values = np.array([x for r in rows for x in r], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = {}
    for a, b, n in pair_counts(values, offsets, heavy, tile=8, block=16):
        for x, y, c in zip(a, b, n):
            key = (min(x, y), max(x, y))
            got[key] = got.get(key, 0) + int(c)
    assert got == want


def test_overlap_sizes(spark):
    rng = random.Random(5)
    sets = {n: set(rng.sample(range(300), k)) for n, k in [("a", 10), ("b", 150), ("c", 299), ("d", 5), ("e", 60)]}
    rows = [(n, str(x), 1) for n, s in sets.items() for x in s for _ in range(rng.choice([1, 1, 3]))]
    rows += [(None, "1", 1), ("a", None, 1), ("alone", "x", 1)]
    df = spark.createDataFrame(rows, "name string, id string, shared int")
    got = {(r.name_a, r.name_b): (r.size_a, r.size_b, r.shared) for r in overlap_sizes(df, "name", ["id"], heavy_degree=2).collect()}
    want = {(x, y): (len(sets[x]), len(sets[y]), len(sets[x] & sets[y])) for x, y in itertools.combinations("abcde", 2) if sets[x] & sets[y]}
    assert got == want
    assert overlap_sizes(df.limit(0), "name", ["id"]).count() == 0


# --- percentiles ------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["lognormal", "sorted", "ties"])
def test_sketch_rank_error(kind):
    rng = np.random.default_rng(3)
    x = {"lognormal": rng.lognormal(0, 3, 200_000), "sorted": np.arange(1.0, 200_001), "ties": rng.integers(1, 20, 200_000).astype(float)}[kind]
    parts = [RankSketch(32) for _ in range(20)]
    for s, p in zip(parts, np.array_split(x, 20)):
        for chunk in np.array_split(p, 7):
            s.add(chunk)
    whole = RankSketch(32)
    for s in parts:
        whole.merge(RankSketch.from_bytes(s.to_bytes()))
    assert whole.count == len(x)
    order = np.sort(x)
    for q in [0.01, 0.5, 0.9, 0.99, 0.999, 0.9999]:
        v = whole.quantiles([q])[0]
        low, high = np.searchsorted(order, v, "left") / len(x), np.searchsorted(order, v, "right") / len(x)
        off = max(0.0, low - q, q - high)
        assert off <= 0.03 * (1 - q) + 2 / len(x), (q, off)
    assert sum(len(l[2]) for l in whole.levels) < 12_000
    assert whole.quantiles([0, 1]) == [x.min(), x.max()]


def test_summaries_by_group_and_day(spark):
    rng = random.Random(1)
    rows = [(g, d, [rng.lognormvariate(0, 1) for _ in range(rng.randrange(6))]) for g in ["a", "b", None] for d in range(4) for _ in range(60)]
    rows += [("a", 0, None), ("a", 0, [float("nan"), float("inf"), 0.0, -1.0, None]), ("none", 1, [0.0])]
    df = spark.createDataFrame(rows, "grp string, day int, v array<double>").repartition(9).withColumn("sketch", F.lit(1))
    direct = percentiles(summaries(df, ["grp"], "v", section=256), {"median": 0.5}).collect()
    daily = percentiles(combine(summaries(df, ["grp", "day"], "v", section=256), ["grp"]), {"median": 0.5}).collect()
    want = {}
    for g in ["a", "b", None]:
        x = sorted(v for r in rows if r[0] == g and r[2] for v in r[2] if v and math.isfinite(v) and v > 0)
        want[g] = (len(x), x[math.ceil(len(x) / 2) - 1])
    assert {r.grp: (r.n, r.median) for r in direct} == want == {r.grp: (r.n, r.median) for r in daily}
    assert percentiles(summaries(df.limit(0), ["grp"], "v"), {"m": 0.5}).count() == 0
    scalar = df.select("grp", F.explode_outer("v").alias("v"))
    assert {r.grp: (r.n, r.m) for r in percentiles(summaries(scalar, ["grp"], "v", section=256), {"m": 0.5}).collect()} == want


# --- similarity clusters ----------------------------------------------------------------------------


def brute_clusters(ids, values, least=0.9):
    width = max(len(v) for v in values)
    x = np.full((len(values), width), np.nan)
    for i, v in enumerate(values):
        for j, e in enumerate(v):
            if e is not None and math.isfinite(e) and e > 0:
                x[i, j] = math.log2(1 + e)
    near = correlations(x, x) >= least
    label = {i: i for i in ids}
    for _ in range(len(ids)):
        new = {ids[k]: min(label[ids[j]] for j in [k, *np.flatnonzero(near[k])]) for k in range(len(ids))}
        if new == label:
            break
        label = new
    sizes = {}
    for v in label.values():
        sizes[v] = sizes.get(v, 0) + 1
    return {i: v for i, v in label.items() if sizes[v] > 1}


def profiles(seed, groups, hot=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(10, 1.2, 48)
        for _ in range(int(rng.integers(1, 6)) + (hot if g == 0 else 0)):
            v = 2 ** (base + rng.normal(0, 0.12, 48) + rng.normal(0, 1))
            v = [None if rng.random() < 0.02 else float(e) if rng.random() > 0.02 else [0.0, float("nan")][int(rng.integers(2))] for e in v]
            rows.append(v)
            if rng.random() < 0.1:
                rows.append(list(v))
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 1, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("most", [4096, 40])
def test_clusters_match_brute_force(spark, most):
    rows = profiles(2, 60, hot=150)
    odd = [(10_001, None), (10_002, []), (10_003, [1.0] * 48), (10_004, [None] * 48), (10_005, [5.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "rid long, conditions array<double>").withColumn("pivot", F.lit("clash"))
    clusters = profile_clusters(df, most=most)
    got = {r.rid: r.head_rid for r in clusters.collect()}
    want = brute_clusters([r[0] for r in rows], [r[1] for r in rows])
    assert got == want
    top = describe_clusters(df, clusters).collect()
    groups = {r.head_rid: r["size"] for r in describe_clusters(df.drop("pivot"), clusters, by="pivot").collect()}
    assert groups and set(groups) <= set(got) and max(groups.values()) <= len(got)
    sizes = {}
    for v in want.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert {r.head_rid: r["size"] for r in top} == sizes
    assert all(want[r.rid] == r.head_rid for r in top) and {r.place for r in top} <= {1, 2, 3}
    assert profile_clusters(df.limit(0)).count() == 0


def test_medoid_is_the_member_closest_to_all_others(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(10, 1.2, 48)
    rows = [(i, [float(v) for v in 2 ** (base + rng.normal(0, 0.15, 48) + rng.normal(0, 1)) - 1]) for i in range(12)]
    df = spark.createDataFrame(rows, "rid long, conditions array<double>")
    r = np.corrcoef(np.log2(1 + np.array([v for _, v in rows])))
    mean = (r.sum(axis=1) - 1) / 11
    top = sorted(describe_clusters(df, profile_clusters(df)).collect(), key=lambda x: x.place)
    assert [x.rid for x in top] == list(np.argsort(-mean)[:3]) and np.allclose([x.r for x in top], np.sort(mean)[::-1][:3])


def test_chain_is_one_cluster(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(10, 1, 48), rng.normal(10, 1, 48)
    rows = [(i, [float(v) for v in 2 ** (a * math.cos(t) + b * math.sin(t))]) for i, t in enumerate(np.linspace(0, math.pi / 2, 9))]
    df = spark.createDataFrame(rows, "rid long, conditions array<double>")
    assert {r.rid: r.head_rid for r in profile_clusters(df).collect()} == brute_clusters([r[0] for r in rows], [r[1] for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_hot_cluster_is_whole(spark, seed):
    """A long chain whose records are all in hot buckets: links run through border records of different parts."""
    rng = np.random.default_rng(seed)
    walk, way = rng.normal(0, 1, 48), [rng.normal(0, 1, 48)]
    for _ in range(240):
        walk = walk - walk.mean()
        step = rng.normal(0, 1, 48)
        walk = walk / np.linalg.norm(walk) + 0.42 * step / np.linalg.norm(step)
        way.append(walk)
    rows = [(i, [float(v) for v in 2 ** (12 + 6 * (w - w.mean()) / np.linalg.norm(w - w.mean()))]) for i, w in enumerate(way)]
    df = spark.createDataFrame(rows, "rid long, conditions array<double>")
    want = brute_clusters([r[0] for r in rows], [r[1] for r in rows])
    assert max(sum(v == h for v in want.values()) for h in set(want.values())) > 150
    assert {r.rid: r.head_rid for r in profile_clusters(df, most=4).collect()} == want


def test_pairs_with_few_common_entries_are_found(spark):
    """Missing entries widen the angle the buckets see far beyond their design point."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(60):
        base = rng.normal(10, 1.2, 48)
        for k in range(2):
            v = 2 ** (base + rng.normal(0, 0.2, 48) + rng.normal(0, 1))
            rows.append((2 * g + k, [float(e) if rng.random() > 0.5 else None for e in v]))
    df = spark.createDataFrame(rows, "rid long, conditions array<double>")
    want = brute_clusters([r[0] for r in rows], [r[1] for r in rows])
    assert len(want) > 80
    assert {r.rid: r.head_rid for r in profile_clusters(df).collect()} == want


def test_open_links_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    x = np.log2(1 + np.array([[np.nan if e is None or not e > 0 else e for e in r[1]] for r in profiles(8, 40)]))
    x[:20, rng.permutation(48)[:45]] = np.nan
    near = correlations(x, x) >= 0.9
    i, j, r = open_links(x, np.arange(len(x)), x, np.arange(len(x)), 0.9, rows=16, cols=32)
    assert near[i, j].all() and np.allclose(r, paired(x[i], x[j])) and np.allclose(paired(x, x[::-1]), np.diag(correlations(x, x[::-1])))
    label = np.arange(len(x))
    for _ in range(len(x)):
        for a, b in zip(i, j):
            label[[a, b]] = min(label[a], label[b])
    p, q = np.nonzero(near)
    assert (label[p] == label[q]).all() and len(i) == len(x) - len(set(label))


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1)] + [(100 + i, 99) for i in range(50)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4)) and all(got[i] == 7 for i in (7, 8, 9)) and got[5] == 5
    assert all(got[100 + i] == 99 for i in range(50)) and all(got[i] == 200 for i in range(200, 241))


# --- packing ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
    plan = plan_containers(dict(counts), 100)
    used = {}
    for items, times in plan:
        assert sum(items) <= 100 and times > 0
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in plan) <= max(math.ceil(total / 100 * 11 / 9) + 1, sum(v for k, v in counts.items() if k > 50) + math.ceil(total / 100))


def test_plan_of_small_cases():
    best = lambda c, cap: sum(t for _, t in plan_containers(c, cap))
    assert best({60: 3, 40: 3}, 100) == 3
    assert best({}, 100) == 0
    assert best({100: 2, 1: 1}, 100) == 3
    assert best({50: 5}, 100) == 3
    assert best({70: 2, 30: 1, 20: 1, 10: 1}, 100) == 2


def test_fill_containers(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([5, 7, 33, 50, 99, 100, 250, 1000])) for i in range(700)] + [(None, 5), (900, 0), (901, None)]
    df = spark.createDataFrame(rows, "id long, tokens long").repartition(7)
    out = fill_containers(df, capacity=100).collect()
    load, parts = {}, {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.tokens
        parts.setdefault(r.id, []).append((r.first_token, r.tokens))
    assert max(load.values()) <= 100
    assert sorted(parts) == list(range(700))
    for i, n in rows[:700]:
        at = 0
        for first, size in sorted(parts[i]):
            assert first == at
            at += size
        assert at == n and (len(parts[i]) == 1 or n > 100)
    assert sum(load.values()) == sum(n for _, n in rows[:700]) and len(load) <= math.ceil(sum(load.values()) / 100) * 1.1 + 1
    assert len({(r.container, r.place) for r in out}) == len(out)
    assert fill_containers(df.limit(0)).count() == 0


def test_containers_of_all_documents(spark, data):
    """Every document once, none over the capacity, little space unused against the sum of all lengths."""
    from loomspan.llm.queries import p7_containers

    rows = p7_containers(spark, data, capacity=256).collect()
    load, parts = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.tokens
        parts[r.id] = parts.get(r.id, 0) + r.tokens
    want = {r[0] for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").where(F.regexp_replace("text", r"[\\s\u00a0]+", "") != "").select("doc_id").collect()}
    assert set(parts) == want and max(load.values()) <= 256 and len(rows) == len({(r.id, r.part) for r in rows})
    assert len(load) <= 1.03 * sum(load.values()) / 256 + 1


def test_token_lengths(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([(1, "the cat sat"), (2, ""), (3, "  \n"), (4, None), (5, "x" * 20_000)], "doc_id long, text string")
    got = {r.id: r.tokens for r in token_lengths(df, "doc_id", "text", path).collect()}
    assert got[1] == 3 and sorted(got) == [1, 5] and got[5] > 100


# --- leakage ----------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row


def test_myers_matches_dynamic_programming():
    rng = np.random.default_rng(0)
    pattern, text = rng.integers(0, 4, (300, 20)).astype(np.uint8), rng.integers(0, 4, (300, 22)).astype(np.uint8)
    text[::2, :20] = pattern[::2]
    text[::4, 3] = 9
    size = rng.integers(0, 21, 300)
    got = myers_prefix(pattern, size, text, 3)
    for p, m, t, g in zip(pattern, size, text, got):
        assert g == min([4, *levenshtein(p[:m], t)[1:]]) if m else g == 0


ITEM = "Technicians at Rin Bay noticed that Ess-85 binds halqua only while the spore sac is kept under 647 turns, never above."


def test_leak_shapes(spark):
    w = re.findall(r"\w+", ITEM)
    docs = {
        1: "Intro. " + " ".join(w[2:14]) + " end.", 2: "Intro. " + " ".join(w[2:13]) + " end.", 3: ITEM.upper(), 4: "<p>" + ITEM.replace("noticed", "no<b>tic</b>ed").replace(" ", "&nbsp;") + "</p>",
        5: ITEM.replace("spore", "sp" + chr(0xAD) + "o" + chr(0x200B) + "re"), 6: ITEM.replace("noticed", "no-\nticed"), 7: ITEM.replace(" ", "_ * "), 8: ITEM.replace("halqua", "halquo").replace("noticed", "saw").replace("kept", "held"),
        9: None, 10: "", 11: " ".join(w[2:14])[1:], 12: "x" * 50_000 + " " + ITEM, 13: ITEM.replace("only", "\n> only").replace("kept", "\r\n| kept"), 14: "nothing here", 15: ITEM,
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, ITEM), (8, "too short to leak"), (9, None), (10, "")], "item_id long, text string")
    got = find_leaks(df, items).where("edits = 0").select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == {(i, 7) for i in (1, 3, 4, 5, 6, 7, 12, 13, 15)}
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0
    loose = find_leaks(spark.createDataFrame([(1, " ".join(w[2:14]).replace("while", "whyle"))], "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.edits) for r in loose] == [(1, 1)]


def test_myers_over_several_blocks():
    rng = np.random.default_rng(1)
    pattern = rng.integers(97, 101, (200, 150)).astype(np.uint8)
    text = np.concatenate([pattern, rng.integers(97, 101, (200, 3)).astype(np.uint8)], axis=1)
    size = rng.integers(0, 151, 200)
    for k in range(200):
        for at in rng.integers(0, 150, k % 4):
            text[k, at] = 120
        if k % 5 == 0:
            text[k] = np.insert(text[k], rng.integers(0, 150), 121)[:-1]
    for budget in (1, 3):
        got = myers_prefix(pattern, size, text, budget)
        for p, m, t, g in zip(pattern, size, text, got):
            assert g == min([budget + 1, *levenshtein(p[:m], t)[1:]]) if m else g == 0


def test_long_flanks_are_compared_whole():
    """Twelve long words: a change behind the 64th character of a half counts like any other."""
    words = [f"{c}{'immunoprecipitation' * 2}{k}" for k, c in enumerate("abcdefghijklmno")]
    item = " ".join(words)
    docs = {
        "same": words[1:13], "two words replaced": [*words[1:11], "other", "things"], "late letter": [*words[1:12], words[12][:-1] + "x"], "early letter": ["x" + words[1][1:], *words[2:13]],
        "two letters": [*words[1:12], "xx" + words[12][2:]], "goes on": [*words[1:12], words[12] + "s"], "accents": [*words[1:12], words[12][:-2] + "éé"],
    }
    index = ItemIndex.build([5, 6], [item, item], 6)
    d, i, e = leaks_in(index, Words([plain(" ".join(w)) for w in docs.values()]), 1, most=1)
    got = {list(docs)[k]: int(x) for k, x in zip(d, e)}
    assert got == {"same": 0, "late letter": 1, "early letter": 1, "goes on": 1} and sorted(set(i.tolist())) == [0, 1] and len(d) == 8


def test_leaks_match_brute_force():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcde", k=rng.randrange(1, 4))) for _ in range(12)]
    items = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(8)]
    docs = []
    for _ in range(150):
        text = rng.choices(vocabulary, k=20)
        it = rng.choice(items).split()
        s = rng.randrange(20)
        text[5:5] = it[s : s + rng.randrange(4, 16)]
        docs.append(" ".join(text))
    gram = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    want = {(d, i) for d, t in enumerate(docs) for i, it in enumerate(items) if gram(t) & gram(it)}
    index = ItemIndex.build(list(range(8)), items, 6)
    d, i, e = leaks_in(index, Words([plain(t) for t in docs]), 1)
    assert {(a, b) for a, b, c in zip(d.tolist(), i.tolist(), e.tolist()) if c == 0} == want


# --- subjects ---------------------------------------------------------------------------------------


def test_sentences():
    s = Sentences(["Dear all,\n\nOne two. Three four?\nHeading\nFive 1.5 six!", "", "no end", "A b\nc d."])
    whole = [int(d) for d, w in zip(s.doc, s.whole) if w]
    assert whole == [0, 0, 0, 3]


def test_words_of_rare_subject_outlast_a_large_vocabulary(spark):
    """25,000 codes that are each in more sentences than any word of the rare subject."""
    rng = random.Random(2)
    rare, codes = [f"rye{k}" for k in range(12)], [f"code{k}" for k in range(25_000)]
    docs = [(i, " ".join(f"The {rng.choice(rare)} and the {rng.choice(rare)} had and has been seen." for _ in range(4))) for i in range(30)]
    docs += [(100 + i, " ".join(f"The ball{rng.randrange(12)} and the ball{rng.randrange(12)} had and has been seen." for _ in range(4))) for i in range(60)]
    for part in range(250):
        docs += [(1000 + 40 * part + k, "The list had and has been seen " + " ".join(codes[part * 100 : part * 100 + 100]) + ".") for k in range(30)]
    labels = [(i, "crops") for i in range(10)] + [(100 + i, "sport") for i in range(20)]
    got = subject_shares(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"))
    found = {(r.doc_id, r.subject) for r in got.collect()}
    assert {(i, "crops") for i in range(30)} <= found and {(100 + i, "sport") for i in range(60)} <= found


def test_subject_without_a_label_is_found(spark):
    rng = random.Random(4)
    words = {"law": ["consent", "privacy", "contract", "licence", "court"], "sport": ["sprint", "athlete", "race", "coach", "medal"], "teaching": ["pupil", "lesson", "exam", "school", "essay"]}
    truth = list(enumerate(sorted(words) * 40))
    docs = [(i, " ".join(f"The {rng.choice(words[s])} and the {rng.choice(words[s])} had been seen." for _ in range(6)) + " The rest was left out." * 3) for i, s in truth]
    labels = spark.createDataFrame([(i, s) for i, s in truth[:60] if s != "law"], "doc_id long, subject string")
    subjects = spark.createDataFrame([("Law ", "Consent, privacy and a contract"), ("sport", "Race and athlete"), ("crops", None), (None, "x")], "subject string, about string")
    got = subject_shares(spark.createDataFrame(docs, "doc_id long, text string"), labels, subjects=subjects)
    assert {(r.doc_id, r.subject) for r in got.where("sentences * 6 >= of").collect()} == set(truth)


def test_subjects_of_the_table_that_no_label_notes(spark, data):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    items = read("eval_items").select(F.concat_ws(" ", "text", "kind").alias("text"))
    noted = {r[0] for r in read("doc_labels").select(F.lower(F.trim("subject"))).distinct().collect()}
    got = subject_shares(read("documents"), read("doc_labels"), items, read("subjects")).where("sentences * 6 >= of")
    new = {"chromatin", "law", "motifs"}
    assert not new & noted and new <= {r.subject for r in got.select("subject").distinct().collect()}


def test_subject_of_another_language_is_learned(spark):
    """A subject found only in German texts, another in both languages; the small words speak for neither."""
    rng = random.Random(9)
    words = {"crops": ["weizen", "gerste", "roggen", "hafer", "ernte"], "sport": ["sprint", "athlete", "race", "coach", "medal"], "law": ["consent", "privacy", "contract", "licence", "court"]}
    docs, truth = [], set()
    for i in range(360):
        s = ["crops", "sport", "law", None, None, "sport"][i % 6]
        german = s == "crops" or i % 6 > 3
        say = (lambda a, b: f"Auch der {a} und die {b} wurden hier gesehen.") if german else (lambda a, b: f"The {a} and the {b} had been seen here.")
        other = [f"{'haus' if german else 'room'}{k}" for k in range(40)]
        docs.append((i, " ".join([say(rng.choice(words[s]), rng.choice(words[s])) for _ in range(4) if s] + [say(rng.choice(other), rng.choice(other)) for _ in range(4)]), "de" if german else "EN"))
        truth |= {(i, s)} if s else set()
    labels = [(i, s) for i, s in sorted(truth) if i < 240]
    got = subject_shares(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, subject string"))
    assert {(r.doc_id, r.subject) for r in got.where("sentences * 6 >= of").collect()} == truth


def test_subjects(spark):
    rng = random.Random(11)
    words = {s: [f"{s}{k}" for k in "abcdefghijklmnopqrst"] for s in ("law", "sport", "crops")}
    item_words = [f"bay{k}" for k in "abcdefghijkl"]
    sentence = lambda ws: f"The {rng.choice(ws)} and the {rng.choice(ws)} were seen by us near run {rng.randrange(99)}."
    filler = lambda: rng.choice(["Nothing else changed since then.", "Figures are rounded.", "The room was booked until four."])
    docs, truth = [], {}
    for i in range(400):
        subjects = rng.sample(sorted(words), rng.choice([0, 1, 1, 2]))
        body = [sentence(words[s]) for s in subjects for _ in range(4)] + [filler() for _ in range(3)] + ([sentence(item_words)] * 2 if i % 9 == 0 else [])
        rng.shuffle(body)
        docs.append((i, "Dear all,\n\n" + " ".join(body) + "\n\nYours, me"))
        truth[i] = set(subjects)
    docs += [(1000, None), (1001, "")]
    labels = [(i, s.upper() + " ", "r") for i in range(120) for s in truth[i]] + [(5, "law", "r"), (None, "law", "r"), (6, None, "r")]
    items = [(k, " ".join(sentence(item_words) for _ in range(5))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, subject string, reader string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in subject_shares(df, lab, it).where("share >= 1/6").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.98 * len(truth) and 1000 not in got and 1001 not in got
    assert subject_shares(df, lab.limit(0), it).count() == 0
    assert subject_shares(df.limit(0), lab, it).count() == 0


def test_llm_stays_apart():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "loomspan"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "loomspan.llm" not in p.read_text(), p
