"""Dimension reduction, clustering and graphs.

Rows stay distributed; what is gathered on the driver is a matrix over conditions, a codebook or a set of
leaf points, whose size is checked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.matrix import V

#: Points that a driver-side method takes at most.
MOST_POINTS = 10_000

#: Points up to which clustering keeps all distances.
DENSE_POINTS = 2_000

#: Pairs of points that are laid out at a time when groups are compared.
LOOSE_PAIRS = 1_000_000


def _gathered(df: DataFrame, key: str) -> tuple[list, np.ndarray]:
    rows = df.select(key, V).limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"this method runs on the driver and takes at most {MOST_POINTS} points; reduce or cluster first")
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def pca(df: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with ``scores`` (array), loadings (conditions x k) and explained shares, by a distributed covariance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = len(df.select(V).first()[0])
    centre = df.agg(F.array(*[F.avg(F.col(V)[i]) for i in range(width)])).scalar()
    ready = df.withColumn("_c", centre).withColumn("_v", array_to_vector(F.zip_with(V, "_c", lambda x, m: x.cast("double") - m))).drop("_c")
    model = PCA(k=k, inputCol="_v", outputCol="_s").fit(ready)
    out = model.transform(ready).withColumn("scores", vector_to_array("_s")).drop("_v", "_s")
    return out, model.pc.toArray(), model.explainedVariance.toArray()


def top_loadings(loadings: np.ndarray, names: list[str], component: int, top: int) -> list[tuple[str, float]]:
    """Conditions with the largest and smallest loadings of a component (counted from 1)."""
    order = np.argsort(-loadings[:, component - 1], kind="stable")
    pick = [*order[:top], *order[len(order) - top :]] if 2 * top < len(order) else list(order)
    return [(names[i], float(loadings[i, component - 1])) for i in pick]


def kmeans(df: DataFrame, k: int, *, seed: int = 1) -> DataFrame:
    """Rows with ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(F.transform(V, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready).drop("_v")


def bisecting(df: DataFrame, k: int, *, seed: int = 1) -> DataFrame:
    """Rows with ``cluster`` by bisecting k-means: the hierarchical choice for many rows."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(F.transform(V, lambda x: x.cast("double"))))
    return BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready).drop("_v")


def _distances(points: np.ndarray) -> np.ndarray:
    """All distances of a few points; coordinates are taken in blocks, so that memory follows the pairs."""
    n, wide = points.shape
    if n > DENSE_POINTS:
        sq = (points**2).sum(1)
        return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * points @ points.T, 0))
    d, step = np.zeros((n, n)), max(1, 4_000_000 // max(n * n, 1))
    for s in range(0, wide, step):
        d += ((points[:, None, s : s + step] - points[None, :, s : s + step]) ** 2).sum(-1)
    return np.sqrt(d)


def linkage(points: np.ndarray, method: str = "complete") -> np.ndarray:
    """Merges (a, b, height, size) of agglomerative clustering by nearest-neighbour chains: complete, average, single or ward."""
    d = _distances(points)
    return _tree_of(_merged(d**2 if method == "ward" else d, np.ones(len(points)), method), len(points))


def _merged(d: np.ndarray, size: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) from the distances of points or groups (ward: their squares) by nearest-neighbour chains; a < b stand for all that was merged into them."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    chain: list[int] = []
    merges = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            near = int(np.where(alive, d[at], np.inf).argmin())
            if len(chain) > 1 and d[at, chain[-2]] <= d[at, near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        height = d[a, b]
        na, nb = size[a], size[b]
        if method == "complete":
            new = np.maximum(d[a], d[b])
        elif method == "single":
            new = np.minimum(d[a], d[b])
        elif method == "average":
            new = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            new = ((na + size) * d[a] + (nb + size) * d[b] - size * height) / (na + nb + size)
        merges.append((a, b, math.sqrt(height) if method == "ward" else height))
        size[a] += size[b]
        alive[b] = False
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
    return merges


def _tree_of(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """The merges by height, with nodes numbered from ``n`` on."""
    merges = sorted(merges, key=lambda m: m[2])
    node, members, out = {i: i for i in range(n)}, {i: 1 for i in range(n)}, []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b, h) in enumerate(merges):
        x, y = find(a), find(b)
        out.append((min(node[x], node[y]), max(node[x], node[y]), h, members[x] + members[y]))
        root[y] = x
        node[x], members[x] = n + k, members[x] + members[y]
    return np.array(out, float).reshape(-1, 4)


def _squares(xt: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of points (by coordinate) to one point."""
    d = np.zeros(xt.shape[1])
    for row, at in zip(xt, point):
        t = row - at
        d += t * t
    return d


def _tiles(p: np.ndarray, q: np.ndarray):
    """First place in ``p`` and squared distances of all points of ``p`` (by coordinate) to those of ``q``, tile by tile."""
    side = max(1, 500_000 // max(q.shape[1], 1))
    for s in range(0, p.shape[1], side):
        part = p[:, s : s + side]
        d, t = np.zeros((part.shape[1], q.shape[1])), np.empty((part.shape[1], q.shape[1]))
        for row, other in zip(part, q):
            np.subtract(row[:, None], other, out=t)
            np.multiply(t, t, out=t)
            d += t
        yield s, d


def _widest(p: np.ndarray, q: np.ndarray) -> float:
    """Largest squared distance of the points of two large groups: only points that can be as far apart as two that were found are compared."""
    of_p, of_q = p.mean(axis=1), q.mean(axis=1)
    a, b = _squares(p, of_q), _squares(q, of_p)
    best = max(_squares(q, p[:, a.argmax()]).max(), _squares(p, q[:, b.argmax()]).max())
    least = math.sqrt(best) * (1 - 1e-9) - 1e-12 * len(p) * max(np.abs(p).max(), np.abs(q).max())
    p_reach, q_reach = math.sqrt(_squares(p, of_p).max()), math.sqrt(_squares(q, of_q).max())
    p, q = p[:, np.sqrt(a) + q_reach >= least], q[:, np.sqrt(b) + p_reach >= least]
    return max([best, *(d.max() for _, d in _tiles(p, q))])


def _between(xt: np.ndarray, weight: np.ndarray, start: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """Squared complete or average distances of pairs of groups, from the pairs of their points (``xt`` by coordinate, a group's points together)."""
    a, b = np.minimum(a, b), np.maximum(a, b)  # one order of sums for either direction
    pairs = count[a] * count[b]
    out, ends = np.empty(len(a)), np.cumsum(pairs)
    s = 0
    while s < len(a):
        if pairs[s] > LOOSE_PAIRS:  # two large groups, not laid out pair by pair
            i, j = (np.s_[start[g] : start[g] + count[g]] for g in (a[s], b[s]))
            if method == "complete":
                out[s] = _widest(xt[:, i], xt[:, j])
            else:
                w, v = weight[i], weight[j]
                out[s] = (sum(w[k : k + len(d)] @ np.sqrt(d) @ v for k, d in _tiles(xt[:, i], xt[:, j])) / (w.sum() * v.sum())) ** 2
            s += 1
            continue
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + LOOSE_PAIRS, "right")))
        n, wide = pairs[s:e], count[b[s:e]]
        first = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(first, n)
        wide = np.repeat(wide, n)
        i, j = np.repeat(start[a[s:e]], n) + inner // wide, np.repeat(start[b[s:e]], n) + inner % wide
        d = np.zeros(len(i))
        for row in xt:
            t = row[i] - row[j]
            d += t * t
        if method == "complete":
            out[s:e] = np.maximum.reduceat(d, first)
        else:
            w = weight[i] * weight[j]
            out[s:e] = (np.add.reduceat(w * np.sqrt(d), first) / np.add.reduceat(w, first)) ** 2
        s = e
    return out


def _cut(x: np.ndarray, most: int = 128) -> list[np.ndarray]:
    """Places of points in blocks of near ones, halved at the widest coordinate."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        own, half = x[at], len(at) // 2
        order = np.argpartition(own[:, int(np.ptp(own, axis=0).argmax())], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _group_linkage(points: np.ndarray, method: str = "complete") -> np.ndarray:
    """``linkage`` of any number of points, in memory that grows with the points, not with their pairs.

    Groups that are each other's nearest are merged, all in a round, which gives the tree of merging one by one, as no merge
    brings a third group nearer. A group's nearest is searched from block to block: the distance of two groups is at least what
    their centres and spreads tell, so only groups whose bound isn't above the best distance so far are compared point by point.
    When few groups are left, all their distances are made. Equal points are merged first; ties go to the group made first.
    """
    n = len(points)
    if not np.isfinite(points).all():
        raise ValueError("a tree needs finite values")
    if method == "single":
        return _tree_of(_spanning_merges(points), n)
    _, first, same = np.unique(points + 0.0, axis=0, return_index=True, return_inverse=True)
    same = same.ravel()
    merges = [(int(first[g]), i, 0.0) for i, g in enumerate(same.tolist()) if first[g] != i]
    weight = np.bincount(same).astype(float)
    order = np.argsort(first)
    first, weight = first[order], weight[order]
    x = points[first]
    scale = 1e-9 * max(1e-300, float((x**2).sum(axis=1).max()))  # more than what rounding can do to a bound
    label, stands, height, near, apart = np.arange(len(x)), first, np.zeros(len(x)), np.full(len(x), -1), np.full(len(x), np.inf)
    while True:
        m = len(stands)
        place = np.argsort(label, kind="stable")
        count = np.bincount(label, minlength=m)
        start = np.cumsum(count) - count
        xt, w = np.ascontiguousarray(x[place].T), weight[place]
        mass = np.add.reduceat(w, start)
        centre = np.stack([np.add.reduceat(w * row, start) / mass for row in xt], axis=1)
        if m <= DENSE_POINTS:
            break
        off = ((xt.T - centre[label[place]]) ** 2).sum(axis=1)
        # squares for complete, of which the largest is at least the mean; the mean distance and Ward's are at least that of the centres
        spread = np.add.reduceat(w * off, start) / mass if method == "complete" else np.zeros(m)
        reach = np.sqrt(np.maximum.reduceat(off, start))
        blocks = _cut(centre)
        low, high = np.array([centre[b].min(axis=0) for b in blocks]), np.array([centre[b].max(axis=0) for b in blocks])
        for k, block in enumerate(blocks):
            q = block[near[block] < 0]
            if not len(q):
                continue
            best, who = np.full(len(q), np.inf), np.full(len(q), -1)
            apart_boxes = (np.maximum(0, np.maximum(low - high[k], low[k] - high)) ** 2).sum(axis=1)
            visit, seen = [k], False
            while visit:
                for v in visit:
                    some = np.arange(len(q)) if not seen else np.flatnonzero(gap[:, v] <= best + scale)  # noqa: F821
                    if not len(some):
                        continue
                    i, t = q[some], blocks[v]
                    square = np.maximum((centre[i] ** 2).sum(axis=1)[:, None] + (centre[t] ** 2).sum(axis=1) - 2 * centre[i] @ centre[t].T, 0)
                    self = i[:, None] == t
                    if method == "ward":
                        bound = square * (2 * mass[i][:, None] * mass[t] / (mass[i][:, None] + mass[t]))
                        top = bound
                    else:
                        bound = square + spread[i][:, None] + spread[t]
                        top = (np.sqrt(square + scale) + reach[i][:, None] + reach[t]) ** 2
                    cap = np.minimum(best[some], np.where(self, np.inf, top).min(axis=1)) * (1 + 1e-9) + scale
                    r, c = np.nonzero((bound <= cap[:, None]) & ~self)
                    if not len(r):
                        continue
                    if method == "ward":
                        a, b = np.minimum(i[r], t[c]), np.maximum(i[r], t[c])
                        d = 2 * mass[a] * mass[b] / (mass[a] + mass[b]) * ((centre[a] - centre[b]) ** 2).sum(axis=1)
                    else:
                        d = _between(xt, w, start, count, i[r], t[c], method)
                    r, c = some[r], t[c]
                    o = np.lexsort((c, d, r))
                    o = o[np.r_[True, r[o][1:] != r[o][:-1]]]
                    r, c, d = r[o], c[o], d[o]
                    nearer = (d < best[r]) | ((d == best[r]) & (c < who[r]))
                    best[r[nearer]], who[r[nearer]] = d[nearer], c[nearer]
                if seen:
                    break
                seen = True
                visit = np.flatnonzero(apart_boxes <= best.max() + scale)
                visit = visit[visit != k]
                visit = visit[np.argsort(apart_boxes[visit], kind="stable")].tolist()
                gap = np.full((len(q), len(blocks)), np.inf) if visit else None
                for s in range(0, len(visit), 256):
                    v = visit[s : s + 256]
                    gap[:, v] = (np.maximum(0, np.maximum(low[v] - centre[q][:, None], centre[q][:, None] - high[v])) ** 2).sum(axis=2)
            near[q], apart[q] = who, best
        all_groups = np.arange(m)
        a = np.flatnonzero((near[near] == all_groups) & (all_groups < near))
        b = near[a]
        if not len(a):
            raise AssertionError("no two groups are each other's nearest")
        tall = np.maximum(np.sqrt(apart[a]), np.maximum(height[a], height[b]))
        merges += zip(stands[a].tolist(), stands[b].tolist(), tall.tolist())
        gone = np.zeros(m, bool)
        gone[a] = gone[b] = True
        left = np.flatnonzero(~gone)
        number = np.empty(m, int)
        number[left] = np.arange(len(left))
        number[a] = number[b] = len(left) + np.arange(len(a))
        label = number[label]
        kept = np.where(gone[near[left]], -1, number[near[left]])
        near, apart = np.r_[kept, np.full(len(a), -1)], np.r_[apart[left], np.full(len(a), np.inf)]
        stands, height = np.r_[stands[left], stands[a]], np.r_[height[left], tall]
    if method == "ward":
        d = _distances(centre) ** 2 * (2 * mass[:, None] * mass / (mass[:, None] + mass))
    else:
        d = _group_distances(xt, w, label[place], m, method) / (mass[:, None] * mass if method == "average" else 1)
    for a, b, h in _merged(d, mass.copy(), method):
        height[a] = h = max(h, height[a], height[b])
        merges.append((int(stands[a]), int(stands[b]), float(h)))
    return _tree_of(merges, n)


def _group_distances(xt: np.ndarray, weight: np.ndarray, label: np.ndarray, groups: int, method: str) -> np.ndarray:
    """Largest distance of the points of two groups, or the weighted sum of their distances (``average``), in tiles of all pairs of points."""
    whole, n, side = np.zeros((groups, groups)), len(label), 512
    starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    fold = np.maximum if method == "complete" else np.add
    for s in range(0, n, side):
        own = label[s : s + side]
        rows = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for t in range(s, n, side):
            other = label[t : t + side]
            d, step = np.zeros((len(own), len(other))), np.empty((len(own), len(other)))
            for row in xt:
                np.subtract(row[s : s + side, None], row[t : t + side], out=step)
                np.multiply(step, step, out=step)
                d += step
            if method == "average":
                d = np.sqrt(d) * (weight[s : s + side, None] * weight[t : t + side])
            cols = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
            part = fold.reduceat(fold.reduceat(d, rows, axis=0), cols, axis=1)
            at = np.s_[own[0] : own[-1] + 1, other[0] : other[-1] + 1]
            whole[at] = fold(whole[at], part)
            if t > s:
                at = at[::-1]
                whole[at] = fold(whole[at], part.T)
    return np.sqrt(whole) if method == "complete" else whole


def _spanning_merges(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of single linkage: the edges of a minimum spanning tree, grown point by point."""
    rest, xt = np.arange(1, len(points)), points[1:].T.copy()
    best, who, at, out = np.full(len(rest), np.inf), np.zeros(len(rest), int), 0, []
    while len(rest):
        d = np.zeros(len(rest))
        for k, row in enumerate(xt):
            d += (row - points[at, k]) ** 2
        nearer = d < best
        best, who = np.where(nearer, d, best), np.where(nearer, at, who)
        k = int(best.argmin())
        at = int(rest[k])
        out.append((int(who[k]), at, math.sqrt(best[k])))
        last = len(rest) - 1  # the last takes its place
        for v in (rest, best, who):
            v[k] = v[last]
        xt[:, k] = xt[:, last]
        rest, best, who, xt = rest[:last], best[:last], who[:last], xt[:, :last]
    return out


def cut_tree(merges: np.ndarray, n: int, clusters: int) -> np.ndarray:
    """Cluster numbers of the leaves, in order of first appearance, when the tree is cut to so many."""
    root = list(range(2 * n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k in range(max(0, n - clusters)):
        a, b = int(merges[k, 0]), int(merges[k, 1])
        root[find(a)] = root[find(b)] = n + k
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen)) for i in range(n)])


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right."""
    if n == 1:
        return [0]
    stack, out = [n + len(merges) - 1], []
    while stack:
        i = int(stack.pop())
        if i < n:
            out.append(i)
        else:
            stack += [merges[i - n, 1], merges[i - n, 0]]
    return out


def tree(df: DataFrame, key: str, *, method: str = "complete", clusters: int | None = None) -> tuple[list, np.ndarray, np.ndarray | None]:
    """Keys in leaf order, merges and, if asked, the cluster number of each key, in the same order as the keys."""
    keys, x = _gathered(df, key)
    m = linkage(x, method)
    order = leaf_order(m, len(keys))
    return [keys[i] for i in order], m, cut_tree(m, len(keys), clusters)[order] if clusters else None


def column_tree(df: DataFrame, names: list[str], *, method: str = "complete", clusters: int | None = None) -> tuple[list, np.ndarray, np.ndarray | None]:
    """``tree`` over the conditions, whatever the number of rows: their distances come from sums of products, made in one aggregate."""
    flat = df.select(F.transform(V, lambda x: x.cast("double")).alias("v"))
    n = len(names)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = flat.agg(F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs]).alias("s")).first()[0]
    gram = np.zeros((n, n))
    for (i, j), s in zip(pairs, sums):
        gram[i, j] = gram[j, i] = s or 0.0
    values, vectors = np.linalg.eigh(gram)
    m = linkage(vectors * np.sqrt(np.maximum(values, 0)), method)
    order = leaf_order(m, n)
    return [names[i] for i in order], m, cut_tree(m, n, clusters)[order] if clusters else None


def mds(points: np.ndarray, k: int = 2) -> np.ndarray:
    """Classical multidimensional scaling."""
    # doubly centred squared distances are products of centred points, so their coordinates come from those: no matrix of all pairs
    left, size, _ = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
    out = left[:, :k] * size[:k]
    return np.pad(out, ((0, 0), (0, k - out.shape[1])))


def tsne(points: np.ndarray, *, perplexity: float = 30.0, rounds: int = 500, seed: int = 1) -> np.ndarray:
    """Exact t-SNE to two dimensions, started from the first two principal components."""
    n = len(points)
    size = (points**2).sum(axis=1)
    sq = np.maximum(size[:, None] + size - 2 * points @ points.T, 0)
    p = np.zeros((n, n))
    target = math.log(min(perplexity, (n - 1) / 3 if n > 3 else 1.0001))
    for i in range(n):
        low, high, beta = 0.0, math.inf, 1.0
        for _ in range(60):
            w = np.exp(-(sq[i] - np.delete(sq[i], i).min()) * beta)
            w[i] = 0
            total = w.sum()
            entropy = math.log(total) + beta * ((sq[i] - np.delete(sq[i], i).min()) * w).sum() / total
            if abs(entropy - target) < 1e-5:
                break
            low, high = (beta, high) if entropy > target else (low, beta)
            beta = beta * 2 if high == math.inf else (low + high) / 2
        p[i] = w / total
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    centred = points - points.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = (u[:, :2] * s[:2]) if s.size > 1 else np.random.default_rng(seed).standard_normal((n, 2))
    y = y / max(y.std(), 1e-12) * 1e-4
    step, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(n / 48, 50.0)
    for k in range(rounds):
        size = (y**2).sum(axis=1)
        q = 1 / (1 + np.maximum(size[:, None] + size - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        pq = ((12 if k < 250 else 1) * p - np.maximum(q / q.sum(), 1e-12)) * q
        grad = 4 * (pq.sum(1)[:, None] * y - pq @ y)
        gain = np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8).clip(0.01)
        step = (0.5 if k < 250 else 0.8) * step - rate * gain * grad
        y = y + step
        y -= y.mean(0)
    return y


def umap(points: np.ndarray, *, neighbours: int = 15, min_dist: float = 0.1, rounds: int = 200, k: int = 2, seed: int = 1) -> np.ndarray:
    """Uniform manifold approximation: a fuzzy graph of nearest neighbours, laid out by attraction along it and sampled repulsion.

    Neighbours are found in blocks of distances; memory grows with points * neighbours. Copies of a point are its nearest neighbours.
    """
    n = len(points)
    near = min(neighbours, n - 1)
    rng = np.random.default_rng(seed)
    if near < 1:
        return np.zeros((n, k))
    square = (points**2).sum(axis=1)
    who, far = np.zeros((n, near), int), np.zeros((n, near))
    for s in range(0, n, 512):
        d = np.maximum(square[s : s + 512, None] + square - 2 * points[s : s + 512] @ points.T, 0)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        some = np.argpartition(d, near - 1, axis=1)[:, :near]
        who[s : s + len(d)], far[s : s + len(d)] = some, np.sqrt(np.take_along_axis(d, some, axis=1))
    rho = far.min(axis=1, keepdims=True)
    low, high = np.zeros((n, 1)), np.full((n, 1), np.inf)
    sigma = np.ones((n, 1))
    for _ in range(64):  # the width at which a point's memberships add up to log2 of its neighbours
        over = np.exp(-np.maximum(far - rho, 0) / sigma).sum(axis=1, keepdims=True) > math.log2(max(near, 2))
        high, low = np.where(over, sigma, high), np.where(over, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    member = np.exp(-np.maximum(far - rho, 0) / np.maximum(sigma, 1e-9)).ravel()
    a, b = np.repeat(np.arange(n), near), who.ravel()
    keys, where = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
    total = np.bincount(where, weights=member)
    both = np.zeros(len(keys))
    first = np.bincount(where, weights=np.where(a < b, member, 0))
    both = first * (total - first)
    weight = total - both  # union of both directions
    head, tail = keys // n, keys % n
    # the curve 1 / (1 + p d^2q) closest to a step at ``min_dist`` with an exponential tail
    x = np.linspace(0, 3, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist)))
    grid = [((1 / (1 + p * x ** (2 * q)) - y) ** 2).sum() for p in np.linspace(0.3, 3, 55) for q in np.linspace(0.5, 1.5, 41)]
    at = int(np.argmin(grid))
    p, q = np.linspace(0.3, 3, 55)[at // 41], np.linspace(0.5, 1.5, 41)[at % 41]
    centred = points - points.mean(axis=0)
    _, _, axes = np.linalg.svd(centred.T @ centred)
    out = centred @ axes[:k].T if points.shape[1] >= k else np.pad(centred, ((0, 0), (0, k - points.shape[1])))
    out = 10 * out / max(np.abs(out).max(), 1e-12) + rng.normal(0, 1e-4, (n, k))
    chance = weight / weight.max()
    for step in range(rounds):
        rate = 1 - step / rounds
        on = rng.random(len(keys)) < chance
        h, t = head[on], tail[on]
        diff = out[h] - out[t]
        d = (diff**2).sum(axis=1, keepdims=True)
        pull = np.clip(-2 * p * q * np.where(d > 0, d, 1) ** (q - 1) / (1 + p * d**q) * diff * (d > 0), -4, 4) * rate
        np.add.at(out, h, pull)
        np.add.at(out, t, -pull)
        h = np.concatenate([h, t])
        for _ in range(5):
            t = rng.integers(0, n, len(h))
            diff = out[h] - out[t]
            d = (diff**2).sum(axis=1, keepdims=True)
            push = np.clip(2 * q / ((0.001 + d) * (1 + p * d**q)) * diff, -4, 4) * rate
            np.add.at(out, h, push)
    return out


def embed(df: DataFrame, key: str, method: str, **options) -> DataFrame:
    """``key, x, y`` of a driver-side map: ``mds``, ``tsne`` or ``umap``."""
    keys, x = _gathered(df, key)
    y = {"mds": mds, "tsne": tsne, "umap": umap}[method](x, **options)
    return df.sparkSession.createDataFrame(pd.DataFrame({key: keys, "x": y[:, 0], "y": y[:, 1]}))


def som(df: DataFrame, key: str, rows: int, cols: int, *, epochs: int = 10, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Batch self-organising map: ``key, node`` and the codebook (nodes x conditions).

    Each epoch finds best nodes and sums members per node on the workers (one partial row per task and node); the
    driver smooths the ``rows * cols`` sums over the grid.
    """
    width = len(df.select(V).first()[0])
    s = df.agg(F.array(*[F.avg(F.col(V)[i]) for i in range(width)]).alias("m"), F.array(*[F.stddev_pop(F.col(V)[i]) for i in range(width)]).alias("s")).first()
    nodes = rows * cols
    rng = np.random.default_rng(seed)
    code = np.array(s.m) + rng.standard_normal((nodes, width)) * np.array(s.s)
    grid = np.stack(np.divmod(np.arange(nodes), cols), axis=1).astype(float)
    away = ((grid[:, None, :] - grid[None, :, :]) ** 2).sum(-1)

    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)

    for e in range(epochs):
        radius = max(rows, cols) / 2 * (0.5 / max(rows, cols)) ** (e / max(epochs - 1, 1))

        def sums(frames, code=code):
            total, count = np.zeros((nodes, width)), np.zeros(nodes)
            for pdf in frames:
                x = np.array(pdf[V].tolist(), float)
                best = nearest(x, code)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=nodes)
            used = np.flatnonzero(count)
            yield pd.DataFrame({"node": used, "n": count[used], "total": list(total[used])})

        parts = df.select(V).mapInPandas(sums, "node long, n double, total array<double>")
        got = parts.groupBy("node").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("t")).collect()  # at most rows * cols
        total, count = np.zeros((nodes, width)), np.zeros(nodes)
        for r in got:
            total[r.node], count[r.node] = r.t, r.n
        h = np.exp(-away / (2 * radius * radius))
        weight = h @ count
        code = np.where(weight[:, None] > 1e-9, (h @ total) / np.maximum(weight, 1e-9)[:, None], code)

    def place(frames, code=code):
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "node": nearest(np.array(pdf[V].tolist(), float), code)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, V).mapInPandas(place, f"`{key}` {kind}, node long"), code


def project(df: DataFrame, key: str, codebook: np.ndarray, k: int = 1) -> DataFrame:
    """``key, nodes, distances``: the k nearest nodes of a codebook."""

    def run(frames):
        for pdf in frames:
            x = np.array(pdf[V].tolist(), float)
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (codebook**2).sum(1)[None, :] - 2 * x @ codebook.T, 0))
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({key: pdf[key], "nodes": list(at), "distances": list(np.take_along_axis(d, at, 1))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, V).mapInPandas(run, f"`{key}` {kind}, nodes array<long>, distances array<double>")


def classify(df: DataFrame, label: str, kind: str = "svm"):
    """A fitted classifier of the arrays by a 0/1 label: ``svm`` (linear, C = 1) or ``bayes`` (gaussian)."""
    from pyspark.ml.classification import LinearSVC, NaiveBayes
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("features", array_to_vector(F.transform(V, lambda x: x.cast("double")))).withColumn("label", F.col(label).cast("double"))
    return (LinearSVC(regParam=1.0) if kind == "svm" else NaiveBayes(modelType="gaussian")).fit(ready.select("features", "label"))


def spanning_tree(edges: list[tuple]) -> list[tuple]:
    """Minimum spanning forest of (a, b, weight) over conditions."""
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    out = []
    for a, b, w in sorted(edges, key=lambda e: (e[2], str(e[0]), str(e[1]))):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b, w))
    return out


def longest_path(edges: list[tuple]) -> list:
    """Longest shortest path (in steps) of a small graph: breadth first from every node."""
    near: dict = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best: list = []
    for start in sorted(near, key=str):
        before, queue = {start: None}, [start]
        for v in queue:
            for w in sorted(near[v], key=str):
                if w not in before:
                    before[w] = v
                    queue.append(w)
        path, v = [], queue[-1]
        while v is not None:
            path.append(v)
            v = before[v]
        if len(path) > len(best):
            best = path
    return best


def threshold_clusters(points: np.ndarray, keys: list, groups: int) -> dict:
    """Key to cluster: complete linkage cut at the highest threshold with at least ``groups`` clusters.

    Thresholds go down from 1.099 to 0.1 of the largest distance in steps of 0.001; below the last the nearest number stands.
    """
    n = len(points)
    if not n:
        return {}
    merges = linkage(points, "complete")
    square = (points**2).sum(axis=1)
    widest = max((math.sqrt(max(0.0, float((square[s : s + 512, None] + square - 2 * points[s : s + 512] @ points.T).max()))) for s in range(0, n, 512)), default=0.0)
    heights = merges[:, 2]
    for step in range(1000):
        limit = (1.099 - 0.001 * step) * widest
        if n - np.count_nonzero(heights <= limit) >= groups:
            break
    root = list(range(2 * n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b, h, _) in enumerate(merges):
        if h <= limit:
            root[find(int(a))] = root[find(int(b))] = n + k
    seen: dict = {}
    return {key: seen.setdefault(find(i), len(seen)) for i, key in enumerate(keys)}


def branch_paths(edges: list[tuple], expected: int, *, alike: float = 51.0) -> list[list]:
    """The longest path of a small graph, then its ``expected`` longest different branches.

    A branch is a shortest path from a node of the longest path to another node, cut where it comes back to that path, of more
    than two nodes. Of branches that share ``alike`` percent or more of the smaller one's nodes with a longer one, the longer stays.
    """
    spine = longest_path(edges)
    near: dict = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = set()
    for start in spine:
        before, queue = {start: None}, [start]
        for v in queue:
            for w in sorted(near[v], key=str):
                if w not in before:
                    before[w] = v
                    queue.append(w)
        for end in queue:
            path, v = [], end
            while v != start:
                path.append(v)
                v = before[v]
            outside = []
            for v in reversed(path):
                if v in spine:
                    break
                outside.append(v)
            if len(outside) > 2:
                found.add(tuple(outside))
    kept: list[tuple] = []
    for p in sorted(found, key=lambda p: (-len(p), str(p))):
        if all(100.0 * len(set(p) & set(q)) / min(len(p), len(q)) < alike for q in kept):
            kept.append(p)
    return [spine, *map(list, kept[:expected])]


def graph_clusters(edges: list[tuple], nodes: list, clusters: int) -> dict:
    """Node to group: the strongest threshold on r at which the graph falls into at least so many parts."""
    order = sorted(edges, key=lambda e: -e[2])
    root = {n: n for n in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    parts = len(nodes)
    for a, b, _ in order:
        x, y = find(a), find(b)
        if x != y and parts > clusters:
            root[x] = y
            parts -= 1
    seen: dict = {}
    return {n: seen.setdefault(find(n), len(seen)) for n in nodes}


def branches(edges: list[tuple]) -> dict:
    """Node to branch number: parts of a small graph after taking its longest path away; the path is branch 0."""
    path = set(longest_path(edges))
    near: dict = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {n: 0 for n in path}
    number = 0
    for start in sorted(near, key=str):
        if start in out:
            continue
        number += 1
        queue = [start]
        out[start] = number
        for v in queue:
            for w in sorted(near[v], key=str):
                if w not in out:
                    out[w] = number
                    queue.append(w)
    return out


def path_neighbours(edges: list[tuple], path: list, degree: int = 1) -> set:
    """Nodes within ``degree`` steps of a path."""
    near: dict = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = set(path)
    for _ in range(degree):
        found |= {w for v in found for w in near.get(v, ())}
    return found


def rooted_edges(edges: list[tuple], root, threshold: float, most_links: int = 2) -> list[tuple]:
    """Breadth-first edges from a root over (a, b, r) with r >= threshold, at most ``most_links`` new nodes each, strongest first."""
    near: dict = {}
    for a, b, r in edges:
        if r >= threshold:
            near.setdefault(a, {})[b] = r
            near.setdefault(b, {})[a] = r
    seen, queue, out = {root}, [root], []
    for v in queue:
        fresh = sorted(((r, w) for w, r in near.get(v, {}).items() if w not in seen), key=lambda x: (-x[0], str(x[1])))[:most_links]
        for r, w in fresh:
            seen.add(w)
            queue.append(w)
            out.append((v, w, r))
    return out


def correlated_edges(df: DataFrame, key: str, *, low: float, most_links: int = 5) -> list[tuple]:
    """(a, b, r) of the rows' correlations, strongest first, while both ends have fewer than ``most_links`` edges."""
    keys, x = _gathered(df, key)
    centred = x - x.mean(axis=1, keepdims=True)
    size = np.sqrt((centred**2).sum(axis=1, keepdims=True))
    unit = np.where(size > 0, centred / np.where(size > 0, size, 1), 0)
    parts = []
    for s in range(0, len(keys), 512):  # only what reaches ``low`` is kept
        r = unit[s : s + 512] @ unit.T
        i, j = np.nonzero((r >= low) & (np.arange(len(keys)) > np.arange(s, s + len(r))[:, None]))
        parts.append((i + s, j, r[i, j]))
    i, j, r = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, int),) * 3
    degree, out = dict.fromkeys(range(len(keys)), 0), []
    for k in np.lexsort((j, i, -r)):
        a, b, w = int(i[k]), int(j[k]), float(r[k])
        if degree[a] < most_links and degree[b] < most_links:
            degree[a] += 1
            degree[b] += 1
            out.append((keys[a], keys[b], w))
    return out


def heat_payload(df: DataFrame, key: str, names: list[str], *, method: str = "complete", row_norm: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """``key, cond, value, row_order, col_order`` of a clustered heat map: rows and conditions in the order of their trees.

    Any number of rows: the driver holds the values, the tree and the distances of at most ``DENSE_POINTS`` groups. Rows are taken by key, so that equal distances always give the same order.
    """
    ready = df.select(key, F.transform(V, lambda v: v.cast("double")).alias(V))
    held = ready.repartition(1).sortWithinPartitions(key, V).toArrow()
    values = held.column(1).combine_chunks()
    if any(size.as_py() != len(names) for size in pc.unique(pc.list_value_length(values))):
        raise ValueError(f"every row needs {len(names)} values, one for each condition")
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
    if row_norm:
        spread = x.std(axis=1, keepdims=True)
        x = np.where(spread > 0, (x - x.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1), 0)
    if low is not None or high is not None:
        x = x.clip(low, high)
    n = len(x)
    places = np.empty(n, np.int32)
    if n:
        places[leaf_order((linkage if n <= DENSE_POINTS else _group_linkage)(x, method), n)] = np.arange(n)
    cols = np.argsort(leaf_order(linkage(x.T, method), len(names))).tolist()
    cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.array(x.ravel(), pa.float64()))
    kinds = T.StructType().add("_k", df.schema[key].dataType).add("_v", T.ArrayType(T.DoubleType())).add("row_order", T.IntegerType())
    made = df.sparkSession.createDataFrame(pa.table({"_k": held.column(0), "_v": cells, "row_order": pa.array(places)}), kinds)
    each = F.array(*[F.struct(F.lit(name).alias("cond"), F.col("_v")[j].alias("value"), F.lit(place).alias("col_order")) for j, (name, place) in enumerate(zip(names, cols))])
    return made.select("_k", "row_order", F.explode(each).alias("_c")).select(F.col("_k").alias(key), F.col("_c.cond").alias("cond"), F.col("_c.value").alias("value"), "row_order", F.col("_c.col_order").alias("col_order"))


def node_values(codebook: np.ndarray, component: int, near: DataFrame, key: str) -> DataFrame:
    """``key, value``: a component of the codebook at each row's nearest nodes, weighted by 1 / distance (``near`` is ``project``)."""
    values = F.array(*[F.lit(float(v)) for v in codebook[:, component]])
    weight = F.transform("distances", lambda d: 1.0 / F.greatest(d, F.lit(1e-9)))
    at = F.transform("nodes", lambda n: F.get(values, n.cast("int")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return near.select(key, (total(F.zip_with(at, weight, lambda v, w: v * w)) / total(weight)).alias("value"))


def sign_shares(codebook: np.ndarray, component: int, near: DataFrame, key: str) -> DataFrame:
    """``key, positive``: share of the nearest nodes at which a component is above 0."""
    above = F.array(*[F.lit(float(v > 0)) for v in codebook[:, component]])
    hits = F.aggregate(F.transform("nodes", lambda n: F.get(above, n.cast("int"))), F.lit(0.0), lambda a, x: a + x)
    return near.select(key, (hits / F.size("nodes")).alias("positive"))


def strong_nodes(codebook: np.ndarray, component: int, threshold: float = 0.7) -> list[int]:
    """Nodes above (max - min) * threshold in a component."""
    v = codebook[:, component]
    return np.flatnonzero(v > (v.max() - v.min()) * threshold).tolist()


def som_input(df: DataFrame, *, low: float = 1.0, high: float = 7.0) -> DataFrame:
    """Rows whose deviation / mean lies between the bounds."""
    from loomspan.operators.matrix import deviation, mean

    cv = F.try_divide(deviation(), mean())
    return df.where((cv > low) & (cv < high))


def normalise(points: np.ndarray, method: str = "var") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns to mean 0 and deviation 1 (``var``) or to 0..1 (``range``), with the shift and scale of each; a constant column becomes 0."""
    if method not in ("var", "range"):
        raise ValueError("method must be var or range")
    shift = points.mean(axis=0) if method == "var" else points.min(axis=0)
    scale = points.std(axis=0) if method == "var" else np.ptp(points, axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    return (points - shift) / scale, shift, scale


def denormalise(points: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What ``normalise`` was given."""
    return points * scale + shift
