"""Interval joins and interval aggregates on closed intervals.

All range joins go through ``bin_pairs``: both sides are cut into bins, joined on (chromosome, bin), and a
pair is kept in the one bin where the later of the two intervals begins, so no DISTINCT is needed. Bins
are part of the join key, so a chromosome that holds everything is still spread.
"""

from __future__ import annotations

import bisect
import functools
import operator
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.loci import MINUS, PLUS, distance, expand, loc, midpoint, overlaps, pointify
from loomspan.operators.periods import covered_and_gaps
from loomspan.session import checkpointed, laid_out

BIN = 10_000
#: An interval over more bins than this is long: it is joined on bins as many times as wide.
LONG = 64


def _spans(df: DataFrame, at: Column) -> DataFrame:
    """Rows as struct ``r`` with ``chrom, lo, hi`` of their interval."""
    return df.select(F.struct("*").alias("r"), at["chrom"].alias("chrom"), at["left"].alias("lo"), at["right"].alias("hi")).where("chrom is not null and lo <= hi")


def _binned(spans: DataFrame, size: int) -> DataFrame:
    """Once for every bin a row touches: ``r, chrom, bin, first``."""
    first = F.floor(F.col("lo") / size)
    return spans.select("r", "chrom", first.alias("first"), F.explode(F.sequence(first, F.floor(F.col("hi") / size))).alias("bin"))


def bin_pairs(a: DataFrame, b: DataFrame, a_loc: Column, b_loc: Column, *, bin_size: int = BIN, long_intervals: bool = False) -> DataFrame:
    """``a, b``: structs of all pairs of rows that can overlap: the caller adds the exact test on their intervals.

    Null intervals and those with left > right meet nothing. With ``long_intervals`` the rows over more than 64
    bins are joined apart, on bins 64 times as wide, so that a chromosome-wide interval doesn't turn
    into thousands of rows.
    """

    def joined(x: DataFrame, y: DataFrame, size: int) -> DataFrame:
        p, q = _binned(x, size).alias("x"), _binned(y, size).alias("y")
        pairs = p.join(q, (F.col("x.chrom") == F.col("y.chrom")) & (F.col("x.bin") == F.col("y.bin")))
        return pairs.where(F.col("x.bin") == F.greatest("x.first", "y.first")).select(F.col("x.r").alias("a"), F.col("y.r").alias("b"))

    x, y = _spans(a, a_loc), _spans(b, b_loc)
    if not long_intervals:
        return joined(x, y, bin_size)
    long = F.floor(F.col("hi") / bin_size) - F.floor(F.col("lo") / bin_size) >= LONG
    short = joined(x.where(~long), y.where(~long), bin_size)
    return short.unionByName(joined(x.where(long), y, bin_size * LONG)).unionByName(joined(x.where(~long), y.where(long), bin_size * LONG))


def _pairs(a: DataFrame, b: DataFrame, loc_key: str, wide: callable, bin_size: int, long_intervals: bool) -> DataFrame:
    hits = bin_pairs(a, b, wide(F.col(loc_key)), wide(F.col(loc_key)), bin_size=bin_size, long_intervals=long_intervals)
    return hits.where(overlaps(wide(F.col(f"a.{loc_key}")), wide(F.col(f"b.{loc_key}"))))


def collide(a: DataFrame, b: DataFrame, *, delta: int = 200, **options) -> DataFrame:
    """Rows of ``b`` whose midpoint lies within ``2 * delta`` of a midpoint of ``a``; see ``meet``."""
    return meet(a, b, lambda l: expand(pointify(l), delta), delta, **options)


def overlap(a: DataFrame, b: DataFrame, *, delta: int = 0, **options) -> DataFrame:
    """Rows of ``b`` that overlap a row of ``a``, both widened by ``delta``; see ``meet``."""
    return meet(a, b, lambda l: expand(l, delta), delta, **options)


def meet(a: DataFrame, b: DataFrame, wide: callable, delta: int, *, logic: str = "and", loc_key: str = "loc", a_id: str = "rid", b_id: str = "rid", keep_rank: bool = False, merge_keys: bool = False, keep_loc: bool = False, bin_size: int = BIN, long_intervals: bool = False) -> DataFrame:
    """Interval join of two lists by ``wide`` intervals.

    ``and``: a copy of the row of ``b`` for every hit, with ``dist`` (midpoint of a - midpoint of b) and ``loc``
    around the middle of both, ``delta`` to each side. ``keep_rank`` adds both ids, ``merge_keys`` the keys
    only ``a`` has, ``keep_loc`` the original loc. ``notinleft``: rows of ``b`` without a hit, ``notinright``: rows of
    ``a`` without one, ``not``: both; their loc becomes its midpoint.
    """
    if logic == "and":
        hits = _pairs(a, b, loc_key, wide, bin_size, long_intervals)
        la, lb = wide(F.col(f"a.{loc_key}")), wide(F.col(f"b.{loc_key}"))
        half = lambda x: F.when(x < 0, -F.floor(-x / 2)).otherwise(F.floor(x / 2)).cast("bigint")  # noqa: E731  (towards zero)
        middle = loc(la["chrom"], half(la["left"] + lb["left"]), half(la["right"] + lb["right"]))
        out = [F.col(f"b.{c}").alias(c) for c in b.columns if c not in ("loc", "dist")]
        if merge_keys:
            out += [F.col(f"a.{c}").alias(c) for c in a.columns if c not in b.columns]
        if keep_loc:
            out.append(F.col(f"b.{loc_key}").alias("original_loc"))
        if keep_rank:
            out += [F.col(f"a.{a_id}").alias("rank_a"), F.col(f"b.{b_id}").alias("rank_b")]
        return hits.select(*out, expand(pointify(middle), delta).alias("loc"), distance(la, lb).alias("dist"))
    if logic not in ("not", "notinleft", "notinright"):
        raise ValueError(f"unknown logic {logic!r}")

    parts = []
    if logic in ("not", "notinleft"):
        parts.append(without(b, a, wide, loc_key=loc_key))
    if logic in ("not", "notinright"):
        parts.append(without(a, b, wide, loc_key=loc_key))
    parts = [p.withColumn("loc", pointify(F.col(loc_key))) for p in parts]
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def without(df: DataFrame, other: DataFrame, wide: callable, *, loc_key: str = "loc", bin_size: int = BIN) -> DataFrame:
    """Rows of ``df`` whose ``wide`` interval overlaps none of ``other``; rows with a null or reversed interval overlap nothing.

    Existence only, no pairs: the rows of ``other`` become covered periods, which are disjoint, so that a pile-up is one. A row
    looks in the one bin it ends in, of a size not below its length, where the periods of that bin and the one before are:
    one anti join, no DISTINCT. Bins grow 64-fold from size to size, and there are as many sizes as the longest row needs
    (one narrow aggregate finds it).
    """
    w, o = wide(F.col(loc_key)), wide(other[loc_key])
    periods = covered_and_gaps(other.select(o["chrom"].alias("chrom"), o["left"].alias("left"), o["right"].alias("right")), ["chrom"], "left", "right").where("kind = 'covered'")
    sound = F.coalesce(w["chrom"].isNotNull() & (w["left"] <= w["right"]), F.lit(False))
    asked = df.select(F.struct("*").alias("row"), w["chrom"].alias("chrom"), w["right"].alias("pos"), w["left"].alias("from"), sound.alias("sound"))
    size = F.col("pos") - F.col("from")
    longest = asked.where("sound").agg(F.max(size)).first()[0] or 0
    sizes = [bin_size]
    while sizes[-1] < longest:
        sizes.append(sizes[-1] * LONG)
    level = functools.reduce(lambda c, k: c.when(size <= sizes[k], k), range(1, len(sizes)), F.when(size <= sizes[0], 0)).cast("int")
    width = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in sizes]), F.col("level") + 1)
    rows = asked.where("sound").withColumn("level", level).withColumn("bin", F.floor(F.col("pos") / width))
    spread = periods.select("chrom", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("level"))
    placed = spread.select(F.col("chrom").alias("_c"), F.col("level").alias("_l"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width) + 1)).alias("_b"))
    meets = (F.col("chrom") == F.col("_c")) & (F.col("level") == F.col("_l")) & (F.col("bin") == F.col("_b")) & (F.col("lo") <= F.col("pos")) & (F.col("hi") >= F.col("from"))
    return rows.join(placed, meets, "left_anti").select("row.*").unionByName(asked.where("not sound").select("row.*"))


def in_list(df: DataFrame, other: DataFrame, *, mode: str = "collide", delta: int = 200, loc_key: str = "loc", key: str = "rid", bin_size: int = BIN) -> DataFrame:
    """``df`` with ``found`` and ``nearest_dist``: is there a row of ``other`` within reach, and the smallest distance to one."""
    wide = (lambda l: expand(pointify(l), delta)) if mode == "collide" else (lambda l: expand(l, delta))
    df = df.drop("found", "nearest_dist")
    hits = _pairs(df, other, loc_key, wide, bin_size, False)
    d = distance(F.col(f"a.{loc_key}"), F.col(f"b.{loc_key}"))
    best = hits.groupBy(F.col(f"a.{key}").alias("_hit")).agg(F.min_by(d, F.struct(F.abs(d), d)).alias("nearest_dist"))
    return df.join(best, df[key] == F.col("_hit"), "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def features_in(df: DataFrame, chrom: str, left: int, right: int, *, loc_key: str = "loc") -> DataFrame:
    """Rows that overlap one closed interval; a plain pushed-down filter."""
    l = F.col(loc_key)
    return df.where((l["chrom"] == chrom) & (l["right"] >= left) & (l["left"] <= right))


def annotate(genes: DataFrame, peaks: DataFrame, *, distance_bp: int = 10_000, closest_only: bool = False, tss_key: str = "tss_loc", loc_key: str = "loc", peak_id: str = "rid", gene_id: str = "gid", strand: str | None = "strand", bin_size: int = BIN) -> DataFrame:
    """Peaks with the genes whose start lies within ``distance_bp`` of the peak's midpoint.

    ``dist_to_tss`` = midpoint of the peak - start, negated on the minus strand, null for an unknown strand.
    Peak columns win over gene columns. ``closest_only``: the gene with the smallest absolute distance, the
    smallest gene id on ties, one row per peak, found without making the pairs; genes of unknown strand
    don't take part then.
    """
    peaks = peaks.drop("dist_to_tss")
    if strand:
        known = F.col(strand).isin(*PLUS, *MINUS)
        genes = genes.where(known) if closest_only else genes
    out = [c for c in genes.columns if c not in peaks.columns]
    if closest_only:
        found = nearest(peaks.select(F.col(peak_id).alias("id"), pointify(F.col(loc_key)).alias("at")), genes.select(F.col(gene_id).alias("gene"), F.col(tss_key).alias("at")))
        near = found.where(F.abs("dist") <= distance_bp).select(F.col("id").alias("_p"), F.col("gene").alias("_g"), F.col("dist").alias("_d"))
        hits = peaks.join(near, peaks[peak_id] == F.col("_p")).alias("a").join(genes.alias("b"), F.col("_g") == F.col(f"b.{gene_id}"))
        d = F.col("_d")
    else:
        reach = expand(pointify(F.col(loc_key)), distance_bp)
        hits = bin_pairs(peaks, genes, reach, F.col(tss_key), bin_size=bin_size)
        hits = hits.where(overlaps(expand(pointify(F.col(f"a.{loc_key}")), distance_bp), F.col(f"b.{tss_key}")))
        d = distance(F.col(f"a.{loc_key}"), F.col(f"b.{tss_key}"))
    if strand:
        s = F.col(f"b.{strand}")
        d = F.when(s.isin(*PLUS), d).when(s.isin(*MINUS), -d)
    return hits.select(*[F.col(f"a.{c}").alias(c) for c in peaks.columns], *[F.col(f"b.{c}").alias(c) for c in out], d.alias("dist_to_tss"))


def nearest(points: DataFrame, places: DataFrame, *, block_bits: int = 18) -> DataFrame:
    """``id, gene, dist``: the nearest place of each point (both with ``at``, a locus of one position).

    ``dist`` is point - place; of places equally far the smallest ``gene`` wins. An as-of look to both sides: places
    are reduced to one per position, points and places are ordered inside blocks of a chromosome, and per
    block the last place before and the first behind it are carried in. Points without a place on their
    chromosome go.
    """
    spots = places.groupBy(F.col("at.chrom").alias("chrom"), F.col("at.left").alias("pos")).agg(F.min("gene").alias("gene"))
    spots = spots.select("chrom", "pos", F.struct("pos", "gene").alias("spot"), F.lit(None).cast(points.schema["id"].dataType).alias("id"))
    asked = points.select(F.col("at.chrom").alias("chrom"), F.col("at.left").alias("pos"), F.lit(None).cast(spots.schema["spot"].dataType).alias("spot"), "id")
    both = spots.unionByName(asked).withColumn("block", F.shiftright("pos", block_bits)).where("chrom is not null and block is not null").repartition("chrom", "block")
    part = Window.partitionBy("chrom", "block")
    to_here = (Window.unboundedPreceding, 0)
    ordered = both.withColumn("before", F.last("spot", ignorenulls=True).over(part.orderBy("pos", F.col("spot").isNull()).rowsBetween(*to_here)))
    ordered = ordered.withColumn("behind", F.last("spot", ignorenulls=True).over(part.orderBy(F.desc("pos"), F.col("spot").isNull()).rowsBetween(*to_here)))
    earlier = Window.partitionBy("chrom").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("chrom").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("chrom", "block").agg(F.max("spot").alias("last"), F.min("spot").alias("first"))
    blocks = blocks.select("chrom", "block", F.last("last", ignorenulls=True).over(earlier).alias("in_left"), F.last("first", ignorenulls=True).over(later).alias("in_right"))
    found = ordered.where("id is not null").join(blocks, ["chrom", "block"])
    left, right = F.coalesce("before", "in_left"), F.coalesce("behind", "in_right")
    pick = lambda s: F.when(s.isNotNull(), F.struct(F.abs(F.col("pos") - s["pos"]).alias("far"), s["gene"].alias("gene"), (F.col("pos") - s["pos"]).alias("dist")))
    best = F.coalesce(F.least(pick(left), pick(right)), pick(left), pick(right))
    return found.select("id", best.alias("b")).where("b is not null").select("id", "b.gene", "b.dist")


#: Bands of the distance to the start, in kilobases, lower bound included.
BANDS = [(-200, -100), (-100, -50), (-50, -10), (-10, 0), (0, 10), (10, 50), (50, 100), (100, 200)]


def distribution(genes: DataFrame, peaks: DataFrame, **options) -> DataFrame:
    """``band, count, percent``: closest start within 200 kb by distance band; ``desert`` for peaks without one."""
    near = annotate(genes, peaks, distance_bp=200_000, closest_only=True, **options)
    kb = F.col("dist_to_tss") / 1000
    band = functools.reduce(lambda w, b: w.when((kb >= b[0]) & (kb < b[1]), f"{b[0]} to {b[1]}"), BANDS[1:], F.when((kb >= BANDS[0][0]) & (kb < BANDS[0][1]), f"{BANDS[0][0]} to {BANDS[0][1]}"))
    counts = near.select(band.alias("band")).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("count"))
    everything = peaks.agg(F.count(F.lit(1)).alias("n"))
    desert = near.agg(F.count(F.lit(1)).alias("m")).select(F.lit("desert").alias("band"), (everything.select("n").scalar() - F.col("m")).alias("count"))
    whole = counts.unionByName(desert)
    return whole.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))  # nine rows


def cumulative_annotation(genes: DataFrame, peaks: DataFrame, distances: list[int], **options) -> DataFrame:
    """``within, percent``: share of genes with a peak nearer than each distance, from one join at the largest."""
    hits = bin_pairs(genes, peaks, expand(pointify(F.col("tss_loc")), max(distances)), pointify(F.col("loc")), bin_size=options.get("bin_size", BIN))
    d = F.abs(midpoint(F.col("b.loc")) - midpoint(F.col("a.tss_loc")))
    best = hits.groupBy(F.col(f"a.{options.get('gene_id', 'gid')}").alias("g")).agg(F.min(d).alias("d"))
    steps = F.array(*[F.lit(x) for x in distances])
    counts = best.select(F.explode(F.filter(steps, lambda s: s > F.col("d"))).alias("within")).groupBy("within").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("within", (F.col("n") * 100.0 / genes.agg(F.count(F.lit(1))).scalar()).alias("percent"))


def tags_to_tss(tags: DataFrame, genes: DataFrame, low: int, high: int, bin_width: int, *, gene_id: str = "gid", bin_size: int = BIN) -> DataFrame:
    """``gene, bin, count``: tags by strand-aware distance from each start within [low, high)."""
    reach = max(abs(low), abs(high))
    hits = bin_pairs(genes, tags, expand(pointify(F.col("tss_loc")), reach), pointify(F.col("loc")), bin_size=bin_size)
    d = midpoint(F.col("b.loc")) - midpoint(F.col("a.tss_loc"))
    d = F.when(F.col("a.strand").isin(*MINUS), -d).otherwise(d)
    rows = hits.select(F.col(f"a.{gene_id}").alias("gene"), d.alias("d")).where((F.col("d") >= low) & (F.col("d") < high))
    return rows.groupBy("gene", F.floor((F.col("d") - low) / bin_width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def islands(df: DataFrame, wide: callable, *, loc_key: str = "loc", by: list[str] = (), bin_size: int = BIN) -> DataFrame:
    """``df`` with ``island``: the interval of the connected run of overlapping ``wide`` intervals a row is in.

    Intervals must share a position to connect: positions are doubled, so that neighbours don't touch.
    """
    w = wide(F.col(loc_key))
    chrom = F.concat_ws("\x01", w["chrom"], *[F.col(c).cast("string") for c in by])
    base = df.withColumn("_w", F.struct(chrom.alias("chrom"), (w["left"] * 2).alias("left"), (w["right"] * 2).alias("right")))
    runs = covered_and_gaps(base.select("_w.*"), ["chrom"], "left", "right").where("kind = 'covered'")
    runs = runs.select(F.struct("chrom", F.col("lo").alias("left"), F.col("hi").alias("right")).alias("_run"))
    start = F.struct(F.col("_w.chrom").alias("chrom"), F.col("_w.left").alias("left"), F.col("_w.left").alias("right"))
    hits = bin_pairs(base, runs, start, F.col("_run"), bin_size=2 * bin_size, long_intervals=True)
    hits = hits.where((F.col("b._run.left") <= F.col("a._w.left")) & (F.col("a._w.left") <= F.col("b._run.right")))
    island = loc(F.substring_index("b._run.chrom", "\x01", 1), F.col("b._run.left") / 2, F.col("b._run.right") / 2)
    return hits.select("a.*", island.alias("island")).drop("_w")


def cluster_blocks(rows: DataFrame, list_ix: str, lists: int, *, merge_distance: int = 400, loc_key: str = "loc") -> DataFrame:
    """``chrom, left, right, members, cid``: merged blocks of peaks of several lists and who is in them.

    Peaks are their midpoint +- ``merge_distance``; overlapping ones, directly or through others, form a block.
    ``members`` is one 0/1 per list, ``cid`` reads it as a binary number. Independent of row order.
    """
    placed = islands(rows, lambda l: expand(pointify(l), merge_distance), loc_key=loc_key)
    flags = F.array(*[F.max((F.col(list_ix) == i).cast("int")) for i in range(lists)])
    out = placed.groupBy("island").agg(flags.alias("members"))
    cid = functools.reduce(operator.add, [F.col("members")[i].cast("bigint") * (1 << (lists - 1 - i)) for i in range(lists)])
    return out.select("island.chrom", "island.left", "island.right", "members", cid.alias("cid"))


def dedupe_by_loc(df: DataFrame, *, mode: str = "pointify_expand", delta: int = 200, loc_key: str = "loc", order: str = "rid", strand: str | None = None, delete_any_matches: bool = False, bin_size: int = 1 << 24) -> DataFrame:
    """Keep a row if it overlaps no earlier kept row (by ``order``, a unique key); with ``delete_any_matches`` only rows that overlap none.

    Of rows with the same interval only the first can be kept. The others are taken in order inside blocks of
    ``bin_size`` positions, one pass a block; a row over a block's border is settled when all its blocks agree, and what waits
    for one goes into the next round. Rounds are bounded by the blocks of a chromosome, whatever the rows or
    the length of a chain; most data takes two. Null locs are kept.
    """
    wide = (lambda l: expand(pointify(l), delta)) if mode == "pointify_expand" else (lambda l: l)
    by = [strand] if strand else []
    if delete_any_matches:
        placed = islands(df, wide, loc_key=loc_key, by=by)
        alone = placed.groupBy("island", *by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_id")).where("n = 1")
        return df.join(alone.select("_id"), df[order] == F.col("_id"), "left_semi").unionByName(df.where(F.col(loc_key).isNull()))
    w = wide(F.col(loc_key))
    where = F.concat_ws("\x01", w["chrom"], *[F.col(c).cast("string") for c in by])
    spans = df.where(F.col(loc_key).isNotNull()).groupBy(where.alias("c"), w["left"].alias("l"), w["right"].alias("r")).agg(F.min(order).alias("id"))
    low, high = F.floor(F.least("l", "r") / bin_size), F.floor(F.greatest("l", "r") / bin_size)
    left = checkpointed(spans.withColumn("kept", F.lit(False)))
    kind = df.schema[order].dataType.simpleString()
    kept: list[DataFrame] = []
    while not left.isEmpty():
        placed = left.select("*", (low != high).alias("shared"), F.explode(F.sequence(low, high)).alias("block"))
        told = placed.repartition("c", "block").sortWithinPartitions("c", "block", F.desc("kept"), "id").mapInArrow(_settle, f"id {kind}, verdict int, shared boolean, c string, l bigint, r bigint")
        told = checkpointed(told)
        # 0 dropped, 1 kept, 2 waits; a row over a border is kept if no block drops it and none waits
        border = told.where("shared").groupBy("id", "c", "l", "r").agg(F.min("verdict").alias("least"), F.max("verdict").alias("most"))
        border = border.select("id", F.when(F.col("least") == 0, 0).otherwise(F.col("most")).alias("verdict"), "c", "l", "r")
        now = checkpointed(told.where("not shared").select("id", "verdict", "c", "l", "r").unionByName(border))
        kept.append(now.where("verdict = 1").select("id"))
        waiting = now.where("verdict = 2").select("c", "l", "r", "id", F.lit(False).alias("kept"))
        if waiting.isEmpty():
            break
        # what was kept over a border has to be known to those who wait
        left = checkpointed(waiting.unionByName(border.where("verdict = 1").select("c", "l", "r", "id", F.lit(True).alias("kept"))))
    if not kept:
        return df
    ids = functools.reduce(DataFrame.unionAll, kept).withColumnRenamed("id", "_id")
    return df.join(ids, df[order] == F.col("_id"), "left_semi").unionByName(df.where(F.col(loc_key).isNull()))


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of rows that come by (chromosome, block), already kept ones first, then in order."""
    at = None
    lefts: list[int] = []  # kept intervals are disjoint
    rights: list[int] = []
    wait_l: list[int] = []  # waiting ones are merged where they overlap
    wait_r: list[int] = []
    for batch in batches:
        verdicts, told = [], []
        c, block, left, right, shared, kept = (batch.column(n).to_pylist() for n in ("c", "block", "l", "r", "shared", "kept"))
        for k in range(batch.num_rows):
            if (c[k], block[k]) != at:
                at = (c[k], block[k])
                lefts, rights, wait_l, wait_r = [], [], [], []
            l, r = left[k], right[k]
            i = bisect.bisect_right(lefts, r)
            if kept[k]:
                lefts.insert(i, l)
                rights.insert(i, r)
                continue
            told.append(k)
            if i and rights[i - 1] >= l:
                verdicts.append(0)
                continue
            j = bisect.bisect_right(wait_l, r)
            waits = j > 0 and wait_r[j - 1] >= l
            verdicts.append(2 if waits else 1)
            if waits or shared[k]:  # later rows can't be sure of this one
                first = bisect.bisect_left(wait_r, l)
                if first < j:
                    l, r = min(l, wait_l[first]), max(r, wait_r[j - 1])
                wait_l[first:j], wait_r[first:j] = [l], [r]
            else:
                lefts.insert(i, l)
                rights.insert(i, r)
        some = batch.take(pa.array(told, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(verdicts, pa.int32()), *[some.column(n) for n in ("shared", "c", "l", "r")]], names=["id", "verdict", "shared", "c", "l", "r"])


def most_disjoint(df: DataFrame, *, loc_key: str = "loc", order: str = "rid", block_bits: int = 24) -> DataFrame:
    """A largest set of pairwise disjoint intervals per chromosome: greedy by right end, then length, then ``order`` (a unique key).

    A sweep in blocks of right ends. A block needs nothing from the blocks before but the last chosen end; in the first round
    every block starts without one, then the blocks whose carried-in end changed run again. Choices
    made with and without an end before them soon agree, so that most data takes three rounds; the blocks of a chromosome are
    the bound. Null and reversed intervals are never chosen.
    """
    span = F.col(loc_key)
    rows = df.where((span["left"] <= span["right"]) & span["chrom"].isNotNull()).groupBy(span["chrom"].alias("c"), span["left"].alias("l"), span["right"].alias("r")).agg(F.min(order).alias("id"))
    rows = laid_out(rows.withColumn("block", F.shiftright("r", block_bits)), "c", "block")
    kind = df.schema[order].dataType.simpleString()
    schema = f"c string, block bigint, r bigint, id {kind}"
    carried = rows.select("c", "block").distinct().withColumn("reach", F.lit(None).cast("bigint"))
    todo = checkpointed(carried)
    chosen: DataFrame | None = None
    blocks = todo
    while True:
        taken = rows.join(todo.hint("shuffle_hash"), ["c", "block"]).sortWithinPartitions("c", "block", "r", F.col("r") - F.col("l"), "id").mapInArrow(_sweep, schema)
        taken = taken if chosen is None else taken.unionByName(chosen.join(todo, ["c", "block"], "left_anti"))
        chosen = checkpointed(taken)
        ends = blocks.select("c", "block").join(chosen.groupBy("c", "block").agg(F.max("r").alias("end")), ["c", "block"], "left")
        before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = checkpointed(ends.select("c", "block", F.max("end").over(before).alias("reach")))
        todo = checkpointed(carried.join(blocks.withColumnRenamed("reach", "was"), ["c", "block"]).where(~F.col("reach").eqNullSafe(F.col("was"))).drop("was"))
        blocks = carried
        if todo.isEmpty():
            return df.join(chosen.select(F.col("id").alias("_id")), df[order] == F.col("_id"), "left_semi")


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (chromosome, block) in order of their ends, each with the end carried into its block: those chosen."""
    at, reach = None, None
    for batch in batches:
        c, block, left, right, carried = (batch.column(n).to_pylist() for n in ("c", "block", "l", "r", "reach"))
        picked = []
        for k in range(batch.num_rows):
            if (c[k], block[k]) != at:
                at, reach = (c[k], block[k]), carried[k]
            if reach is None or left[k] > reach:
                picked.append(k)
                reach = right[k]
        yield batch.select(["c", "block", "r", "id"]).take(pa.array(picked, pa.int64()))
