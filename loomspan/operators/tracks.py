"""Signal tracks as run-length rows ``chrom, start, end, value`` (half-open, zero runs left out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.loci import MINUS, expand, loc, pointify
from loomspan.operators.intervals import bin_pairs
from loomspan.operators.periods import depth_runs

BIN = 4096


def coverage(reads: DataFrame, *, extend: int = 0, strand: str | None = None, by: list[str] = ()) -> DataFrame:
    """Depth of reads [left, right); with ``extend`` reads grow in the direction of their strand."""
    left, right = F.col("left"), F.col("right")
    if extend:
        minus = F.col(strand or "strand").isin(*MINUS)
        left, right = F.when(minus, left - extend).otherwise(left), F.when(minus, right).otherwise(right + extend)
    made = reads.select("chrom", *by, left.alias("start"), right.alias("end"))
    return depth_runs(made, ["chrom", *by], "start", "end")


def fragment_class(left: Column, right: Column) -> Column:
    """Class by length; fixed values: below 50 none, to 143, to 286, longer."""
    size = right - left
    return F.when(size < 50, F.lit(None)).when(size <= 143, "sub_nucleosome").when(size <= 286, "mono_nucleosome").otherwise("multi_nucleosome")


def fragment_tracks(fragments: DataFrame) -> DataFrame:
    """Coverage by fragment class (``track``); fragments under 50 are dropped."""
    named = fragments.withColumn("track", fragment_class(F.col("left"), F.col("right"))).where("track is not null")
    return coverage(named, by=["track"])


def assign(pieces: DataFrame, order: str = "rid", score: str = "score") -> DataFrame:
    """Track in which of overlapping pieces [left, right) the last one by ``order`` wins; runs of equal winner stay cut at borders."""
    ends = pieces.where("left < right").select("chrom", F.explode(F.array("left", "right")).alias("p")).distinct()
    runs = depth_runs(pieces.select("chrom", F.col("left").alias("start"), F.col("right").alias("end")), ["chrom"], "start", "end")
    inner = bin_pairs(runs, ends, loc(F.col("chrom"), F.col("start"), F.col("end") - 1), loc(F.col("chrom"), F.col("p"), F.col("p")), bin_size=BIN)
    cuts = inner.where("b.p >= a.start and b.p < a.end").select("a.chrom", F.col("b.p").alias("start"), F.col("a.end").alias("run_end"), F.col("a.start").alias("run"))
    following = F.lead("start").over(Window.partitionBy("chrom", "run").orderBy("start"))
    parts = cuts.select("chrom", "start", F.coalesce(following, F.col("run_end")).alias("end"))
    hits = bin_pairs(parts, pieces, loc(F.col("chrom"), F.col("start"), F.col("start")), loc(F.col("chrom"), F.col("left"), F.col("right") - 1), bin_size=BIN, long_intervals=True)
    hits = hits.where("b.left <= a.start and a.start < b.right")
    return hits.groupBy("a.chrom", "a.start", "a.end").agg(F.max_by(f"b.{score}", f"b.{order}").alias("value")).where("value <> 0")


def points_to_track(points: DataFrame, *, files: int = 1) -> DataFrame:
    """Single-position scores (``chrom, pos, score``) summed and divided by the number of files."""
    summed = points.groupBy("chrom", "pos").agg((F.sum("score") / files).alias("value"))
    return summed.where("value <> 0").select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")


def merge_tracks(tracks: DataFrame, by: str, *, mean: bool = False) -> DataFrame:
    """Sum (or mean) of several tracks stacked in one frame with a track column."""
    runs = depth_runs(tracks, ["chrom"], "start", "end", "value")
    if not mean:
        return runs
    return runs.withColumn("value", F.col("value") / tracks.agg(F.count_distinct(by)).scalar())


def get(track: DataFrame, chrom: str, left: int, right: int) -> DataFrame:
    """The runs within [left, right), cut to it."""
    inside = track.where((F.col("chrom") == chrom) & (F.col("end") > left) & (F.col("start") < right))
    return inside.withColumn("start", F.greatest("start", F.lit(left))).withColumn("end", F.least("end", F.lit(right)))


def to_array(track: DataFrame, chrom: str, left: int, right: int) -> DataFrame:
    """``values``: dense array over [left, right); one short stretch, built from its runs."""
    parts = get(track, chrom, left, right).agg(F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("r"))
    at = lambda p: F.filter("r", lambda s: (s["start"] <= p) & (p < s["end"]))
    return parts.select(F.transform(F.sequence(F.lit(left), F.lit(right - 1)), lambda p: F.coalesce(F.get(at(p), 0)["value"].cast("double"), F.lit(0.0))).alias("values"))


def _clipped(track: DataFrame, loci: DataFrame, window: Column, *, bin_size: int = BIN, by: list[str] = ()) -> DataFrame:
    """Rows ``l`` (locus), ``from``, ``to`` (stretch of a run inside the locus' window, half-open), ``value``, and ``by`` of the run."""
    wide = loci.withColumn("_w", window)
    span = loc(F.col("chrom"), F.col("start"), F.col("end") - 1)
    inner = loc(F.col("_w.chrom"), F.col("_w.left"), F.col("_w.right") - 1)
    hits = bin_pairs(wide, track, inner, span, bin_size=bin_size, long_intervals=True)
    hits = hits.where("b.end > a._w.left and b.start < a._w.right")
    return hits.select(F.col("a").alias("l"), F.greatest("b.start", "a._w.left").alias("from"), F.least("b.end", "a._w.right").alias("to"), F.col("b.value").alias("value"), *[F.col(f"b.{c}").alias(c) for c in by])


def pileup(track: DataFrame, loci: DataFrame, *, window: int, strand: str | None = "strand", loc_key: str = "loc", average: bool = True, mask_zero: bool = False, library: float | None = None) -> DataFrame:
    """``offset, value``: mean (or summed) signal per position of a window of ``2 * window`` around the loci's midpoints.

    Minus-strand loci are read backwards. ``mask_zero`` divides by the loci with signal at the offset. Every
    stretch of signal is two events in offset space; the prefix sum runs over offsets, of which there are few.
    """
    size = 2 * window
    middle = F.shiftright(F.col(f"{loc_key}.left") + F.col(f"{loc_key}.right"), 1)
    w = loc(F.col(f"{loc_key}.chrom"), middle - window, middle + window)
    parts = _clipped(track, loci, w)
    a, b = F.col("from") - F.col("l._w.left"), F.col("to") - F.col("l._w.left")
    if strand:
        minus = F.col(f"l.{strand}").isin(*MINUS)
        a, b = F.when(minus, size - b).otherwise(a), F.when(minus, size - a).otherwise(b)
    events = parts.select(F.explode(F.array(F.struct(a.alias("o"), F.col("value").alias("v"), F.lit(1).alias("n")), F.struct(b.alias("o"), (-F.col("value")).alias("v"), F.lit(-1).alias("n")))).alias("e"))
    sums = events.groupBy("e.o").agg(F.sum("e.v").alias("v"), F.sum("e.n").alias("n"))
    grid = track.sparkSession.range(size).select(F.col("id").alias("o")).join(sums, "o", "left")
    upto = Window.partitionBy(F.lit(0)).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)  # at most `size` rows
    total, seen = F.coalesce(F.sum("v").over(upto), F.lit(0.0)), F.coalesce(F.sum("n").over(upto), F.lit(0))
    out = grid.select(F.col("o").alias("offset"), total.alias("t"), seen.alias("k"))
    value = F.col("t")
    if average:
        value = F.coalesce(F.try_divide(value, F.col("k")), F.lit(0.0)) if mask_zero else value / loci.agg(F.count(F.lit(1))).scalar()
    return out.select("offset", (value / library if library else value).alias("value"))


def heat_rows(track: DataFrame, loci: DataFrame, *, key: str = "rid", distance: int = 1000, bins: int = 200, loc_key: str = "loc", log_base: float | None = None, pad: float = 0.1, by: list[str] = ()) -> DataFrame:
    """``key, bin, value`` (and ``by``, columns of the track): signal per locus summed in ``bins`` bins of +- ``distance`` around its midpoint; empty bins are left out."""
    width = 2 * distance // bins
    middle = F.shiftright(F.col(f"{loc_key}.left") + F.col(f"{loc_key}.right"), 1)
    parts = _clipped(track, loci, loc(F.col(f"{loc_key}.chrom"), middle - distance, middle + distance), by=by)
    rel = parts.select(*by, F.col(f"l.{key}").alias(key), (F.col("from") - F.col("l._w.left")).alias("a"), (F.col("to") - F.col("l._w.left")).alias("b"), "value")
    cut = rel.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    share = F.least("b", (F.col("bin") + 1) * width) - F.greatest("a", F.col("bin") * width)
    out = cut.where(F.col("bin") < bins).groupBy(*by, key, "bin").agg(F.sum(F.col("value") * share).alias("value"))
    return out.withColumn("value", F.ln(F.col("value") + pad) / math.log(log_base)) if log_base else out


def density(track: DataFrame, peaks: DataFrame, *, key: str = "rid", method: str = "sum", expand_by: int = 1000, point: bool = True, loc_key: str = "loc", library: float | None = None, log2: bool = False) -> DataFrame:
    """``key, value``: sum, max or average of the signal in every peak (midpoint +- ``expand_by``), per million reads; peaks without signal have 0."""
    inner = expand(pointify(F.col(loc_key)), expand_by) if point else F.col(loc_key)
    parts = _clipped(track, peaks, inner)
    size = F.col("to") - F.col("from")
    span = F.first(F.col("l._w.right") - F.col("l._w.left"))
    value = {"sum": F.sum(F.col("value") * size), "max": F.max("value"), "average": F.sum(F.col("value") * size) / span}[method]
    found = parts.groupBy(F.col(f"l.{key}").alias("_k")).agg(value.cast("double").alias("value"))
    out = peaks.select(key).join(found, peaks[key] == F.col("_k"), "left").select(key, F.coalesce("value", F.lit(0.0)).alias("value"))
    if library:
        out = out.withColumn("value", F.col("value") / (library / 1e6))
    return out.withColumn("value", F.log2(F.col("value") + 0.1)) if log2 else out


def enrichment(track: DataFrame, peaks: DataFrame, *, key: str = "rid", peak_window: int = 200, local: int = 5000, loc_key: str = "loc") -> DataFrame:
    """``key, peak, mean, std, z``: highest signal within the peak window against mean and deviation of its flanks.

    z = (peak - mean) / max(0.001, std), 0 where the peak has no signal. Flanks are [mid - local, mid - window)
    and [mid + window, mid + local); positions without signal count as 0.
    """
    middle = F.shiftright(F.col(f"{loc_key}.left") + F.col(f"{loc_key}.right"), 1)
    with_mid = peaks.withColumn("_mid", middle)
    rows = _clipped(track, with_mid, loc(F.col(f"{loc_key}.chrom"), F.col("_mid") - local, F.col("_mid") + local))
    low, high = F.col("l._mid") - peak_window, F.col("l._mid") + peak_window
    zero = F.lit(0).cast("bigint")
    flank = F.greatest(zero, F.least("to", low) - F.col("from")) + F.greatest(zero, F.col("to") - F.greatest("from", high))
    inside = (F.col("to") > low) & (F.col("from") < high)
    sums = rows.groupBy(F.col(f"l.{key}").alias("_k")).agg(
        F.max(F.when(inside, F.col("value"))).alias("p"), F.sum(F.col("value") * flank).alias("s"), F.sum(F.col("value") * F.col("value") * flank).alias("ss")
    )
    n = 2 * (local - peak_window)
    mean = F.coalesce(F.col("s"), F.lit(0.0)) / n
    std = F.sqrt(F.greatest(F.coalesce(F.col("ss"), F.lit(0.0)) / n - mean * mean, F.lit(0.0)))
    out = peaks.select(key).join(sums, peaks[key] == F.col("_k"), "left").select(key, F.coalesce("p", F.lit(0)).cast("double").alias("peak"), mean.alias("mean"), std.alias("std"))
    return out.withColumn("z", F.when(F.col("peak") > 0, (F.col("peak") - F.col("mean")) / F.greatest("std", F.lit(0.001))).otherwise(0.0))


def redefine_peaks(track: DataFrame, peaks: DataFrame, *, key: str = "rid", threshold: float = 1.2, **options) -> DataFrame:
    """Peaks of ``enrichment`` over both their own limit (mean + threshold * std) and the global one (median + threshold * deviation of the means)."""
    rows = enrichment(track, peaks, key=key, **options)
    limit = rows.agg((F.median("mean") + threshold * F.stddev_pop("mean")).alias("g")).scalar()
    return rows.withColumn("_g", limit).where((F.col("peak") > F.col("_g")) & (F.col("peak") > F.col("mean") + threshold * F.col("std"))).drop("_g")


def scaled_profile(track: DataFrame, loci: DataFrame, *, points: int = 1000, key: str = "rid", loc_key: str = "loc", shortest: int = 50) -> DataFrame:
    """``point, value``: mean signal over loci bodies resampled to ``points`` places by linear interpolation; short bodies are skipped."""
    long = loci.where(F.col(f"{loc_key}.right") - F.col(f"{loc_key}.left") >= shortest)
    runs = _clipped(track, long, F.col(loc_key)).groupBy(F.col(f"l.{key}").alias(key), (F.col("l._w.right") - F.col("l._w.left")).alias("size")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("from") - F.col("l._w.left")).alias("a"), (F.col("to") - F.col("l._w.left")).alias("b"), F.col("value").cast("double").alias("v")))).alias("r")
    )
    at = lambda p: F.coalesce(F.get(F.filter("r", lambda s: (s["a"] <= p) & (p < s["b"])), 0)["v"], F.lit(0.0))
    place = (F.col("point") / F.lit(float(max(points - 1, 1)))) * (F.col("size") - 1)
    spread = runs.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", place)
    low = F.floor("x")
    value = at(low) + (at(F.least(low + 1, F.col("size") - 1)) - at(low)) * (F.col("x") - low)
    sums = spread.groupBy("point").agg(F.sum(value).alias("s"))
    return sums.select("point", (F.col("s") / long.agg(F.count(F.lit(1))).scalar()).alias("value"))


def heat_bins(fragments: DataFrame, *, ybins: int = 50, ymax: int = 500) -> DataFrame:
    """``chrom, bin10, ybin, value``: fragments over each 10 bp bin of [left, right), by length class; lengths from ``ymax`` on are left out.

    A fragment gives at most ``ymax / 10`` rows before they are combined.
    """
    size = F.col("right") - F.col("left")
    low, high = F.floor(F.col("left") / 10), F.floor(F.col("right") / 10) - 1
    rows = fragments.where((size >= 0) & (size < ymax) & (high >= low)).select("chrom", F.explode(F.sequence(low, high)).alias("bin10"), F.floor(size * ybins / ymax).cast("int").alias("ybin"))
    return rows.groupBy("chrom", "bin10", "ybin").agg(F.count(F.lit(1)).alias("value"))


def heat_profile(heat: DataFrame, loci: DataFrame, *, window: int = 1000, loc_key: str = "loc", strand: str | None = "strand") -> DataFrame:
    """``offset, ybin, value``: mean of the 2-D signal around the loci's midpoints, flipped on the minus strand."""
    middle = F.floor(F.shiftright(F.col(f"{loc_key}.left") + F.col(f"{loc_key}.right"), 1) / 10)
    reach = window // 10
    near = loci.withColumn("_m", middle)
    hits = bin_pairs(near, heat, loc(F.col(f"{loc_key}.chrom"), F.col("_m") - reach, F.col("_m") + reach), loc(F.col("chrom"), F.col("bin10"), F.col("bin10")), bin_size=4 * reach)
    d = F.col("b.bin10") - F.col("a._m")
    if strand:
        d = F.when(F.col(f"a.{strand}").isin(*MINUS), -d).otherwise(d)
    sums = hits.where(F.abs(F.col("b.bin10") - F.col("a._m")) <= reach).groupBy(d.alias("offset"), F.col("b.ybin").alias("ybin")).agg(F.sum("b.value").alias("s"))
    return sums.select("offset", "ybin", (F.col("s") / loci.agg(F.count(F.lit(1))).scalar()).alias("value"))


def gerp_rates(lines: DataFrame, chrom: str) -> DataFrame:
    """Track of per-position scores: the second cell of every numbered line (``ordinal, line``) is the score at that position."""
    score = F.get(F.split("line", "\t"), 1).try_cast("double")
    return lines.select(F.lit(chrom).alias("chrom"), F.col("ordinal").alias("start"), (F.col("ordinal") + 1).alias("end"), score.alias("value")).where("value <> 0")


def cluster_heat(track: DataFrame, clusters: DataFrame, *, distance: int = 1000, bins: int = 20) -> DataFrame:
    """``cid, bin, mean``: mean binned signal around the blocks of each cluster id (``chrom, left, right, cid`` of ``cluster_blocks``)."""
    placed = clusters.select(F.xxhash64("chrom", "left", "right").alias("rid"), "cid", loc(F.col("chrom"), F.col("left"), F.col("right")).alias("loc"))
    rows = heat_rows(track, placed, distance=distance, bins=bins)
    sizes = placed.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    sums = rows.join(placed.select("rid", "cid"), "rid").groupBy("cid", "bin").agg(F.sum("value").alias("s"))
    return sums.join(sizes, "cid").select("cid", "bin", (F.col("s") / F.col("n")).alias("mean"))


def cluster_pileup(track: DataFrame, clusters: DataFrame, *, window: int = 1000) -> DataFrame:
    """``cid, offset, value``: mean signal at each distance from the middles of the blocks of each cluster id; see ``pileup``, one for each id, from one join."""
    placed = clusters.select(F.xxhash64("chrom", "left", "right").alias("rid"), "cid", loc(F.col("chrom"), F.col("left"), F.col("right")).alias("loc"))
    middle = F.shiftright(F.col("loc.left") + F.col("loc.right"), 1)
    hits = _clipped(track, placed, loc(F.col("loc.chrom"), middle - window, middle + window))
    at = F.sequence(F.col("from") - F.col("l._w.left") - window, F.col("to") - 1 - F.col("l._w.left") - window)
    sums = hits.select(F.col("l.cid").alias("cid"), "value", F.explode(at).alias("offset")).where(F.col("offset") < window).groupBy("cid", "offset").agg(F.sum("value").alias("s"))
    sizes = placed.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(sizes, "cid").select("cid", "offset", (F.col("s") / F.col("n")).alias("value"))


def save_track(track: DataFrame, path: str, *, total_reads: int | None = None, name: str | None = None) -> None:
    """Store a track: its runs by chromosome, and a table of what is known of it (name, library size, chromosomes with their ends)."""
    from loomspan.sources.writers import write_track

    write_track(track, f"{path}/runs")
    ends = track.groupBy("chrom").agg(F.max("end").alias("size"))
    ends.withColumn("total_reads", F.lit(total_reads).cast("bigint")).withColumn("name", F.lit(name).cast("string")).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def open_track(spark, path: str) -> tuple[DataFrame, dict]:
    """A stored track and ``total_reads``, ``name`` and the ``chromosomes`` with their ends."""
    about = spark.read.parquet(f"{path}/about").collect()  # a row per chromosome
    first = about[0] if about else None
    info = {"total_reads": first and first.total_reads, "name": first and first["name"], "chromosomes": {r.chrom: r["size"] for r in about}}
    return spark.read.parquet(f"{path}/runs"), info


def per_million(track: DataFrame, total_reads: int) -> DataFrame:
    """Values per million reads of the library."""
    return track.withColumn("value", F.col("value") * (1e6 / total_reads))


def list_heat(tracks: DataFrame, by: str, peaks: DataFrame, *, key: str = "rid", **options) -> DataFrame:
    """``by, key, bin, value`` for several tracks stacked in one frame, from one join: the peaks aren't repeated per track."""
    return heat_rows(tracks, peaks.select(key, "loc"), key=key, by=[by], **options).select(by, key, "bin", "value")
