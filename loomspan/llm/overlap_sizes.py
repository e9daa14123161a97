"""Overlap sizes between many large sets, without building the intersections.

Heavy-light split by membership degree: an identifier in few sets gives its few pairs directly; the
identifiers in many sets become 0/1 matrices whose product counts all pairs of sets at once. Both kinds
of counts are added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.session import checkpointed, chunks, column

COUNTS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("shared", T.LongType())])


def pair_counts(values: np.ndarray, offsets: np.ndarray, heavy_degree: int, tile: int = 2048, block: int = 8192, most: int = 1 << 21):
    """Counts of the pairs (a <= b, itself included) of set keys over lists of distinct set keys.

    ``values[offsets[i]:offsets[i + 1]]`` are the sets of identifier i. Yields arrays (a, b, count); a pair may come more than
    once and its counts add up. Memory is bounded by ``most`` pairs and one pair of tiles.
    """
    keys, code = np.unique(values, return_inverse=True)
    degree = np.diff(offsets)
    sets = len(keys)
    for d in np.unique(degree[(degree > 0) & (degree <= heavy_degree)]):
        first = offsets[:-1][degree == d]
        rows = np.sort(code[first[:, None] + np.arange(d)], axis=1)
        x, y = np.triu_indices(d)
        for at in range(0, len(rows), most // len(x) + 1):
            some = rows[at : at + most // len(x) + 1].astype(np.int64)
            pair, count = np.unique((some[:, x] * sets + some[:, y]).ravel(), return_counts=True)
            yield keys[pair // sets], keys[pair % sets], count
    heavy = np.flatnonzero(degree > heavy_degree)
    size = degree[heavy]
    local = np.repeat(np.arange(len(heavy)), size)
    start = np.repeat(offsets[:-1][heavy] - (np.cumsum(size) - size), size)
    member = code[start + np.arange(len(start))]
    tiles = range(0, sets if len(heavy) else 0, tile)
    parts = {}  # the memberships in each tile, by identifier
    for t in tiles:
        inside = np.flatnonzero((member >= t) & (member < t + tile))
        parts[t] = local[inside], member[inside] - t, min(tile, sets - t)

    def dense(t: int, at: int) -> np.ndarray:
        rows, cols, width = parts[t]
        a, b = np.searchsorted(rows, [at, at + block])
        out = np.zeros((min(block, len(heavy) - at), width), np.float32)
        out[rows[a:b] - at, cols[a:b]] = 1
        return out

    for s in tiles:
        for t in tiles:
            if s <= t and len(parts[s][0]) and len(parts[t][0]):
                total = np.zeros((parts[s][2], parts[t][2]), np.int64)  # of one pair of tiles, however many sets there are
                for at in range(0, len(heavy), block):
                    left = dense(s, at)
                    total += (left.T @ (left if s == t else dense(t, at))).astype(np.int64)  # exact: a block has fewer than 2**24 rows
                x, y = np.nonzero(np.triu(total) if s == t else total)
                yield keys[x + s], keys[y + t], total[x, y]


def shared_counts(memberships: DataFrame, set_col: str, id_cols: list[str], *, heavy_degree: int = 12, chunk_rows: int = 200_000) -> DataFrame:
    """``a, b, shared`` for each pair of sets (as 64-bit keys of their names) with a common identifier.

    A set with itself gives its number of distinct identifiers. Rows with a null set or a null
    identifier column don't count, repeated memberships count once. Identifiers are compared by a
    64-bit hash, which is what makes the counts estimates: one pair in 2**64 of them collides.

    One shuffle of (identifier, set) with map-side combining, so that a hot identifier or set arrives
    as at most one small array per map task; an identifier's array is bounded by the number of sets.
    """
    known = F.col(set_col).isNotNull()
    for c in id_cols:
        known = known & F.col(c).isNotNull()
    per_id = (
        memberships.where(known)
        .select(F.xxhash64(set_col).alias("s"), F.xxhash64(*id_cols).alias("k"))
        .groupBy("k")
        .agg(F.collect_set("s").alias("sets"))
        .select("sets")
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), chunk_rows):
            lists = column(table, "sets")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            for a, b, n in pair_counts(values, offsets - offsets[0], heavy_degree):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n.astype(np.int64))], names=COUNTS.names)

    return per_id.mapInArrow(count, COUNTS).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def overlap_sizes(memberships: DataFrame, set_col: str, id_cols: list[str], **options) -> DataFrame:
    """``name_a, name_b, size_a, size_b, shared`` for each pair of different sets with a common identifier, name_a < name_b."""
    counts = checkpointed(shared_counts(memberships, set_col, id_cols, **options))  # at most one row per pair of sets
    named = memberships.where(F.col(set_col).isNotNull()).groupBy(F.col(set_col).alias("name")).agg(F.lit(1)).select("name", F.xxhash64("name").alias("key"))
    sizes = named.join(counts.where("a = b").select(F.col("a").alias("key"), F.col("shared").alias("size")), "key")
    left = sizes.select(F.col("key").alias("a"), F.col("name").alias("n1"), F.col("size").alias("s1"))
    right = sizes.select(F.col("key").alias("b"), F.col("name").alias("n2"), F.col("size").alias("s2"))
    ordered = F.col("n1") < F.col("n2")
    return (
        counts.where("a <> b")
        .join(left, "a")
        .join(right, "b")
        .select(
            F.when(ordered, F.col("n1")).otherwise(F.col("n2")).alias("name_a"),
            F.when(ordered, F.col("n2")).otherwise(F.col("n1")).alias("name_b"),
            F.when(ordered, F.col("s1")).otherwise(F.col("s2")).alias("size_a"),
            F.when(ordered, F.col("s2")).otherwise(F.col("s1")).alias("size_b"),
            "shared",
        )
    )
