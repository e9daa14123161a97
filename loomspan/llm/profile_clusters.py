"""Clusters of records with the same profile, by parallel pivot correlation clustering.

Random-hyperplane signatures bring similar records into common buckets. In every bucket the records are
taken in hash order: the smallest one that nobody has absorbed becomes a pivot and absorbs all similar
ones; every record is held against every pivot of its bucket, and records near the border of a pivot's
reach also against each other. Hot buckets are cut into parts. Links to pivots are then joined to components. The
buckets are a shortcut that joins much of what is similar; an exact pass then holds every record against every
record of another component, in tiles of dense products, so that no link depends on a bucket, a part or a pivot.
Members go to their closest pivot, and the medoids of clusters (or of pivots' groups) are computed from sums of
standardised profiles, without pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.session import checkpointed, chunks, column

#: Design point of the buckets: angle between similar records whose missing entries are filled with their mean.
#: It decides how much the buckets join before the exact pass, not what is found.
ANGLE = 23.0
MISSED = 0.5
LINKS = "rid bigint, pivot bigint, r double"


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row of x with each row of y over the entries that both have (NaN: missing).

    Fewer than three common entries or no variance give 0.
    """
    mx, my = np.isfinite(x), np.isfinite(y)
    fx, fy = mx.astype(float), my.astype(float)
    zx, zy = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    n = fx @ fy.T
    sx, sy, sxy = zx @ fy.T, fx @ zy.T, zx @ zy.T
    vx, vy = n * ((zx * zx) @ fy.T) - sx * sx, n * (fx @ (zy * zy).T) - sy * sy
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (n * sxy - sx * sy) / np.sqrt(vx * vy)
    return np.where((n >= 3) & (vx > 1e-9) & (vy > 1e-9) & np.isfinite(r), r, 0.0)


def absorb(ids: np.ndarray, x: np.ndarray, least: float, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (record, pivot, r) of one bucket given in hash order, and which records are pivots."""
    size = len(ids)
    free = np.ones(size, bool)
    pivot = np.zeros(size, bool)
    reach = math.acos(least)
    slack = math.radians(6)  # missing entries bend the triangle inequality
    nearest = np.full(size, np.inf)
    home = np.full(size, -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    while free.any():
        some = np.flatnonzero(free)[:block]
        r = correlations(x[some], x)
        taken = []
        for row, p in enumerate(some):
            if not free[p]:
                continue
            pivot[p] = True
            taken.append(row)
            free[p] = False
            near = r[row] >= least
            free[near] = False
            near[p] = False
            at = np.flatnonzero(near)
            found.append((at, np.full(len(at), p), r[row][at]))
            closer = np.arccos(np.clip(r[row], -1, 1))
            better = (near | (np.arange(size) == p)) & (closer < nearest)
            nearest[better], home[better] = closer[better], p
        seen.append((some[taken], np.arccos(np.clip(r[taken], -1, 1))))
    for pivots, angle in seen:
        for p, a in zip(pivots, angle):
            mine = np.flatnonzero((home == p) & ~pivot)
            if not len(mine):
                continue
            outside = np.flatnonzero((home != p) & (a <= reach + a[mine].max() + slack) & (home > p) & ~pivot)
            outside = outside[a[outside] > reach]  # linked to p already otherwise
            if len(outside):
                edge = mine[a[mine] + reach + slack >= a[outside].min()]
                for s in range(0, len(edge), 512):
                    r = correlations(x[edge[s : s + 512]], x[outside])
                    i, j = np.nonzero(r >= least)
                    keep = np.unique(j, return_index=True)[1]
                    found.append((outside[j[keep]], edge[s : s + 512][i[keep]], r[i[keep], j[keep]]))
    a, b, r = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return ids[a], ids[b], r, pivot


def open_links(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, least: float, *, rows: int = 256, cols: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row of x, row of y) and r of similar pairs that join two components, every pair compared.

    ``x_at`` and ``y_at`` are the components of the rows. Components that become joined on the way count as one,
    so at most one link less than there are components comes out.
    """
    names, code = np.unique(np.concatenate([x_at, y_at]), return_inverse=True)
    parent = np.arange(len(names))
    cx, cy = code[: len(x)], code[len(x) :]

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    width = x.shape[1]

    def prepared(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Standardised rows (0 where missing), what is known, squares, missing entries, and the most that any k entries hold of the squares."""
        has = np.isfinite(v)
        z = np.where(has, v - np.where(has, v, 0).sum(axis=1, keepdims=True) / np.maximum(has.sum(axis=1, keepdims=True), 1), 0)
        z /= np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)
        held = np.zeros((len(v), width + 1))
        held[:, 1:] = np.cumsum(-np.sort(-z * z, axis=1), axis=1)
        z = z.astype(np.float32)
        return z, has.astype(np.float32), z * z, width - has.sum(axis=1), held

    def whole(a: slice, b: slice) -> np.ndarray:
        """Pairs of a tile that may be similar, from all five products."""
        n, sx, sy = hx[a] @ hy[b].T, zx[a] @ hy[b].T, hx[a] @ zy[b].T
        cov = n * (zx[a] @ zy[b].T) - sx * sy
        vx, vy = n * (qx[a] @ hy[b].T) - sx * sx, n * (hx[a] @ qy[b].T) - sy * sy
        # single precision decides what is clear; the rest, and what little variance is left to, is computed again
        return ((cov >= (least - 0.01) * np.sqrt(np.maximum(vx * vy, 0))) | (np.minimum(vx, vy) < 0.01)) & (n > 2.5)

    def clear(a: slice, b: slice) -> np.ndarray | None:
        """The same from one product, by what the missing entries can change at most; None if that says too little.

        With c the product over common entries, r = (c - s t / n) / sqrt(v w), where s and t are the sums and v and w the
        variances left there. What is lost of a row is at most ``held`` by as many entries as any row of the other side misses.
        """
        lost_x, lost_y = int(my[b].max(initial=0)), int(mx[a].max(initial=0))
        n = width - lost_x - lost_y
        if n < 3:
            return None
        ex, ey = kx[a][:, lost_x], ky[b][:, lost_y]
        u, w = np.maximum(1 - ex * (1 + lost_x / n), 0), np.maximum(1 - ey * (1 + lost_y / n), 0)
        least_c = least * np.sqrt(u * w.min(initial=1)) - np.sqrt(lost_x * ex * (lost_y * ey).max(initial=0)) / n - 1e-4
        maybe = zx[a] @ zy[b].T >= least_c[:, None].astype(np.float32)
        return maybe if np.count_nonzero(maybe) < 0.2 * maybe.size else None

    # rows that miss much come last, so that most tiles miss little
    ox, oy = np.argsort(np.isnan(x).sum(axis=1), kind="stable"), np.argsort(np.isnan(y).sum(axis=1), kind="stable")
    x, y, cx, cy = x[ox], y[oy], cx[ox], cy[oy]
    (zx, hx, qx, mx, kx), (zy, hy, qy, my, ky) = prepared(x), prepared(y)
    found: list[tuple[int, int, float]] = []
    for s in range(0, len(x), rows):
        a = slice(s, s + rows)
        for t in range(0, len(y), cols):
            b = slice(t, t + cols)
            maybe = clear(a, b)
            i, j = np.nonzero(whole(a, b) if maybe is None else maybe)
            other = cx[a][i] != cy[b][j]
            i, j = i[other], j[other]
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)] + s, j[k : k + (1 << 15)] + t
                r = paired(x[p], y[q])
                for m in np.flatnonzero(r >= least):
                    u, v = root(cx[p[m]]), root(cy[q[m]])
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        found.append((p[m], q[m], r[m]))
            if found and len(i):
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                cx, cy = parent[cx], parent[cy]
    p, q, r = zip(*found) if found else ((), (), ())
    return ox[np.array(p, int)], oy[np.array(q, int)], np.array(r, float)


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Like ``correlations``, of each row of x with the same row of y."""
    both = np.isfinite(x) & np.isfinite(y)
    n = both.sum(axis=1)
    x, y = np.where(both, x, 0).astype(float), np.where(both, y, 0).astype(float)
    sx, sy = x.sum(axis=1), y.sum(axis=1)
    vx, vy = n * (x * x).sum(axis=1) - sx * sx, n * (y * y).sum(axis=1) - sy * sy
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (n * (x * y).sum(axis=1) - sx * sy) / np.sqrt(vx * vy)
    return np.where((n >= 3) & (vx > 1e-9) & (vy > 1e-9) & np.isfinite(r), r, 0.0)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of log2(1 + value) with NaN for missing entries; short arrays are filled up, long ones cut off nowhere."""
    out = np.full((len(lists), width), np.nan)
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), sizes)
    cols = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(invalid="ignore", divide="ignore"):
        usable = np.isfinite(values) & (values > 0)
        out[rows[usable], cols[usable]] = np.log2(1 + values[usable])
    return out


def signed_profiles(records: DataFrame, width: int, *, count: int, seed: int = 7) -> DataFrame:
    """``rid, x, keys``: log2(1 + value) in single precision (NaN where missing) and the buckets of each record."""
    bits = max(6, math.ceil(math.log2(max(count, 1) / 24 + 1)))
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - ANGLE / 180) ** bits))
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((width, tables * bits))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 4096):
            x = _matrix(column(table, "conditions"), width)
            has = np.isfinite(x)
            known = np.maximum(has.sum(axis=1, keepdims=True), 1)
            centred = np.where(has, x - np.where(has, x, 0).sum(axis=1, keepdims=True) / known, 0)
            on = (centred @ planes > 0).reshape(len(x), tables, bits)
            keys = (on * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
            flat = pa.array(np.nan_to_num(x, nan=np.nan).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    column(table, "rid"),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), flat),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel())),
                ],
                names=["rid", "x", "keys"],
            )

    return checkpointed(records.select("rid", "conditions").mapInArrow(sign, "rid bigint, x array<float>, keys array<bigint>"))


def profile_links(signed: DataFrame, width: int, *, least: float = 0.9, most: int = 4096, seed: int = 7) -> DataFrame:
    """``rid, pivot, r``: links of each record to similar pivots of its buckets."""
    placed = signed.select("rid", "x", F.explode("keys").alias("bucket"))
    hot = placed.groupBy("bucket").count().where(F.col("count") > most).select("bucket", F.ceil(F.col("count") / most).alias("parts"))
    hot = checkpointed(hot)  # at most rows * tables / most buckets
    split = placed.join(hot, "bucket", "left").select(
        "bucket", F.coalesce(F.pmod(F.xxhash64("rid", "bucket"), F.col("parts")), F.lit(0)).cast("int").alias("part"), "rid", "x"
    )

    def cluster(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive one behind another; a bucket may span batches."""
        names = ["rid", "pivot", "r"]
        held: list[pa.Table] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            bucket, part = column(table, "bucket").to_numpy(), column(table, "part").to_numpy()
            ids = column(table, "rid").to_numpy()
            x = column(table, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0)) + 1
            links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip([0, *cut], [*cut, len(bucket)]):
                if e - s > 1:
                    links.append(absorb(ids[s:e], x[s:e].astype(float), least)[:3])
            a, b, r = (np.concatenate(v) for v in zip(*links)) if links else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(r.astype(float))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held).combine_chunks()
            bucket, part = column(table, "bucket").to_numpy(), column(table, "part").to_numpy()
            last = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield out(table.slice(0, done).combine_chunks())
            held = [table.slice(done)]
        if held:
            yield out(pa.concat_tables(held).combine_chunks())

    dealt = split.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.xxhash64("rid", F.lit(seed)))
    return dealt.mapInArrow(cluster, LINKS).groupBy("rid", "pivot").agg(F.max("r").alias("r"))


def links_between(signed: DataFrame, labels: DataFrame, width: int, *, least: float = 0.9, count: int, tile: int = 40_000) -> DataFrame:
    """``a, b``: groups that a pair of similar records joins; every pair of records of two groups is compared.

    ``signed`` has ``rid`` and ``x``, ``labels`` the group (``node, component``: the closest pivot) of records that
    have one; the others are a group of their own. Records are dealt to groups of about ``tile``; each pair of groups is a task.
    """
    groups = max(6, math.ceil(count / tile))
    cells = groups * (groups + 1) // 2
    own = F.col("own")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    placed = signed.join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left").select(
        F.coalesce("component", "rid").alias("at"), "x", F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(groups)).cast("int").alias("own")
    )
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        (high * (high + 1) / 2 + low).cast("int").alias("cell"), (own == low).alias("first"), (own == high).alias("second"), "at", "x"
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            (column(b, "first").to_numpy(zero_copy_only=False), column(b, "second").to_numpy(zero_copy_only=False), column(b, "at").to_numpy(), column(b, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float))
            for b in chunks(iter(batches), 4096)
        ]
        if parts:
            first, second, at, x = (np.concatenate(v) for v in zip(*parts))
            i, j, _ = open_links(x[first], at[first], x[second], at[second], least)
            yield pa.RecordBatch.from_arrays([pa.array(at[first][i].astype(np.int64)), pa.array(at[second][j].astype(np.int64))], names=["a", "b"])

    return dealt.repartitionById(cells, F.col("cell")).mapInArrow(compare, "a bigint, b bigint")


def profile_clusters(df: DataFrame, id_col: str = "rid", values: str = "conditions", *, least: float = 0.9, **options) -> DataFrame:
    """``rid, head_rid, pivot``: cluster of every record with a partner; ``head_rid`` is the smallest id of the cluster.

    Records are similar if log2(1 + value) over entries positive in both has a Pearson correlation of at
    least ``least``; records joined by similar pairs, directly or through others, form a cluster. Exact
    copies of a profile are one class and count as similar if the profile has at least three positive
    values that differ. Null arrays, records without variance and null ids are in no cluster; arrays may
    differ in length. Two records need three common entries. ``pivot`` is the closest pivot of the record's class.
    Logarithms are held in single precision, which moves a correlation by less than one in a million.
    """
    clean = F.transform(F.col(values), lambda v: F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v.cast("double")))
    usable = df.where(F.col(id_col).isNotNull() & F.col(values).isNotNull()).select(F.col(id_col).cast("bigint").alias("rid"), clean.alias("conditions"))
    solid = F.filter("conditions", lambda v: v.isNotNull())
    usable = usable.where((F.size(solid) >= 3) & (F.array_max(solid) > F.array_min(solid)))
    keyed = checkpointed(usable.select("rid", "conditions", F.xxhash64("conditions").alias("k1"), F.hash("conditions").alias("k2")))
    classes = keyed.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = checkpointed(keyed.join(classes, ["k1", "k2"]).select("rid", "rep", "copies", F.when(F.col("rid") == F.col("rep"), F.col("conditions")).alias("conditions")))
    profiles = reps.where("conditions is not null").select("rid", "conditions")
    size = profiles.agg(F.count(F.lit(1)), F.max(F.size("conditions"))).first()
    if not size[0]:
        return reps.select("rid", F.col("rep").alias("head_rid"), F.col("rep").alias("pivot"))
    signed = signed_profiles(profiles, int(size[1]), count=int(size[0]))
    links = checkpointed(profile_links(signed, int(size[1]), least=least, **options))
    closest = checkpointed(links.groupBy(F.col("rid").alias("rep")).agg(F.max_by("pivot", F.struct("r", -F.col("pivot"))).alias("pivot")))
    rest = links_between(signed, closest.select(F.col("rep").alias("node"), F.col("pivot").alias("component")), int(size[1]), least=least, count=int(size[0]))
    near = components(links.select(F.col("rid").alias("a"), F.col("pivot").alias("b")).unionByName(rest), "a", "b")
    joined = near.select(F.col("node").alias("rep"), F.col("component"))
    return (
        reps.select("rid", "rep", "copies")
        .join(joined, "rep", "left")
        .join(closest, "rep", "left")
        .where("component is not null or copies > 1")
        .select("rid", F.coalesce("component", "rep").alias("head_rid"), F.coalesce("pivot", "rep").alias("pivot"))
    )


def describe_clusters(df: DataFrame, clusters: DataFrame, id_col: str = "rid", values: str = "conditions", *, by: str = "head_rid", typical: int = 3) -> DataFrame:
    """``head_rid, size, place, rid, r``: the most typical members of each cluster, best first; the first is its medoid.

    ``r`` is a member's mean correlation with the other members. As a correlation is the product of two standardised
    profiles, that mean is one product with the sum of all of them, so no pairs are made; sums are combined before the
    shuffle. Missing entries count as the record's mean. Ties go to the smaller id. ``by`` = ``pivot`` describes the
    groups of the closest pivots instead. Null ids and groups of one have no typical member.
    """
    def standardise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), 4096):
            lists = column(table, "v")
            sizes = np.diff(lists.offsets.to_numpy())
            x = _matrix(lists, int(sizes.max(initial=0)))
            has = np.isfinite(x)
            x = np.where(has, x - np.where(has, x, 0).sum(axis=1, keepdims=True) / np.maximum(has.sum(axis=1, keepdims=True), 1), 0)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = x / np.where(norm > 0, norm, 1)
            inside = np.arange(x.shape[1]) < sizes[:, None]
            yield pa.RecordBatch.from_arrays([column(table, "rid"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(x[inside]))], names=["rid", "x"])

    usable = df.where(F.col(id_col).isNotNull() & F.col(values).isNotNull())
    rows = usable.select(F.col(id_col).cast("bigint").alias("rid"), F.col(values).cast("array<double>").alias("v")).mapInArrow(standardise, "rid bigint, x array<double>")
    member = rows.join(clusters.select("rid", F.col(by).alias("head_rid")), "rid")
    sums = member.select("head_rid", F.posexplode("x").alias("pos", "v")).groupBy("head_rid", "pos").agg(F.sum("v").alias("m"))
    centres = sums.groupBy("head_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    sizes = clusters.groupBy(F.col(by).alias("head_rid")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    product = F.aggregate(F.zip_with("x", F.slice("c", F.lit(1), F.size("x")), lambda v, c: v * c), F.lit(0.0), lambda a, v: a + v)
    rank = Window.partitionBy("head_rid").orderBy(F.desc("r"), "rid")
    return (
        member.join(centres, "head_rid")
        .join(sizes, "head_rid")
        .select("head_rid", "size", "rid", F.round((product - 1) / (F.col("size") - 1), 9).alias("r"))
        .withColumn("place", F.row_number().over(rank))
        .where(F.col("place") <= typical)
        .select("head_rid", "size", "place", "rid", "r")
    )
