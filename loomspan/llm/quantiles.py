"""Percentiles per group from mergeable relative-error sketches (relative-rank compactors).

A sketch is a ladder of compactors. The items of level h stand for 2**h values each. A full compactor
sorts itself, protects its upper half and promotes every second item of a stretch of its lower part; how
long the stretch is follows the trailing ones of the number of compactions so far. As the upper tail is
protected, the error in rank is a fraction of the distance from the top: extreme percentiles keep
multiplicative precision. Sketches of partitions or days are merged level by level.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import chunks, column


class RankSketch:
    """Relative-error quantile sketch of finite numbers; ``section`` sets precision and size."""

    def __init__(self, section: int = 32):
        self.section = section + section % 2
        self.count = 0
        self.least = np.inf
        self.most = -np.inf
        task = TaskContext.get()
        self.salt = task.partitionId() if task else 0  # copied partitions throw different coins
        self.levels: list[list] = []  # each [compactions, number of sections, items]

    def _capacity(self, sections: int) -> int:
        return 2 * self.section * sections

    def _level(self, h: int) -> list:
        while len(self.levels) <= h:
            self.levels.append([0, 3, np.zeros(0)])
        return self.levels[h]

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.count += len(values)
            self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
            level = self._level(0)
            level[2] = np.concatenate([level[2], values])
            self._compress()

    def merge(self, other: RankSketch) -> None:
        self.count += other.count
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        for h, (done, sections, items) in enumerate(other.levels):
            level = self._level(h)
            level[0] |= done
            level[1] = max(level[1], sections)
            level[2] = np.concatenate([level[2], items])
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while len(level[2]) > self._capacity(level[1]):
                items = np.sort(level[2])
                ones = (~level[0] & (level[0] + 1)).bit_length() - 1
                stretch = min(ones + 1, level[1])
                kept = self._capacity(level[1]) // 2 + (level[1] - stretch) * self.section
                low = (len(items) - kept) & ~1
                odd = (level[0] * 0x9E3779B1 + h * 0x85EBCA6B + len(items) + self.salt * 0xC2B2AE35) >> 7 & 1  # a coin that repeats if a task is run again
                level[2] = items[low:]
                above = self._level(h + 1)
                above[2] = np.concatenate([above[2], items[odd:low:2]])
                level[0] += 1
                if level[0] >= 1 << (level[1] - 1):  # more sections as more is compacted keep the error bound
                    level[1] *= 2
            h += 1

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted items and the number of values up to and including each."""
        items = np.concatenate([x[2] for x in self.levels] or [np.zeros(0)])
        weight = np.concatenate([np.full(len(x[2]), 1 << h) for h, x in enumerate(self.levels)] or [np.zeros(0, int)])
        order = np.argsort(items, kind="stable")
        return items[order], np.cumsum(weight[order])

    def quantiles(self, shares: list[float]) -> list[float]:
        """Smallest items whose rank is at least the share of all values (nearest rank)."""
        items, upto = self.ranked()
        if not len(items):
            return [float("nan")] * len(shares)
        at = np.searchsorted(upto, np.ceil(np.array(shares) * upto[-1]).clip(1), side="left")
        got = items[np.minimum(at, len(items) - 1)]
        return [self.least if q <= 0 else self.most if q >= 1 else float(x) for q, x in zip(shares, got)]

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqddi", self.section, self.count, self.least, self.most, len(self.levels))
        return head + b"".join(struct.pack("<qqi", d, s, len(x)) + x.astype("<f8").tobytes() for d, s, x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> RankSketch:
        out = cls(2)
        out.section, out.count, out.least, out.most, levels = struct.unpack_from("<iqddi", raw)
        at = struct.calcsize("<iqddi")
        for _ in range(levels):
            done, sections, size = struct.unpack_from("<qqi", raw, at)
            at += struct.calcsize("<qqi")
            out.levels.append([done, sections, np.frombuffer(raw, "<f8", size, at).copy()])
            at += 8 * size
        return out


def summaries(df: DataFrame, groups: list[str], value: str, *, section: int = 32, chunk_rows: int = 100_000, held: int = 20_000) -> DataFrame:
    """``groups..., sketch`` : one mergeable summary per group of all positive finite entries of ``value``.

    ``value`` is an array or a plain number. Null arrays, null, NaN, infinite, zero and negative entries
    don't count; a group without a usable entry has no summary, a null group key is a group of its own.
    Each task sketches its rows, a hot group therefore arrives as one small sketch per task; those are
    merged in two rounds, so that the first round's groups hold about the root of the number of tasks.
    """
    spread = max(1, int(df.rdd.getNumPartitions() ** 0.5)) if not df.isStreaming else 1
    kind = df.schema[value].dataType.typeName()
    array = F.col(value) if kind == "array" else F.array(F.col(value))
    keys = df.select(*groups).schema
    plain = df.select(*groups, F.transform(array, lambda x: x.cast("double")).alias("_values"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, RankSketch] = {}
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % spread

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in found], types[i]) for i in range(len(groups))]
            body = pa.array([x.to_bytes() for x in found.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(found), pa.int32()), body], names=[*groups, "_salt", "sketch"])

        types: list[pa.DataType] = []
        for table in chunks(iter(batches), chunk_rows):
            types = types or [table.schema.field(g).type for g in groups]
            lists = column(table, "_values")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            usable = np.isfinite(values) & (values > 0)
            values, parents = values[usable], parents[usable]
            code, names = np.zeros(table.num_rows, np.int64), [()]
            for g in groups:
                coded = pc.dictionary_encode(column(table, g), null_encoding="encode")
                entries = coded.dictionary.to_pylist()
                code = code * len(entries) + coded.indices.to_numpy(zero_copy_only=False)
                code, names = _dense(code, names, entries)
            order = np.argsort(code[parents], kind="stable")
            values, codes = values[order], code[parents][order]
            edge = np.flatnonzero(np.diff(codes)) + 1
            for part, c in zip(np.split(values, edge), codes[np.concatenate([[0], edge])] if len(codes) else []):
                name = names[c]
                if name not in found:
                    found[name] = RankSketch(section)
                found[name].add(part)
            if len(found) > held:
                yield out()
                found.clear()
        if found:
            yield out()

    parts = plain.mapInArrow(sketch, f"{fields}, _salt int, sketch binary")
    if spread > 2:
        parts = combine(parts, [*groups, "_salt"])
    return combine(parts, groups)


def _dense(code: np.ndarray, names: list[tuple], entries: list) -> tuple[np.ndarray, list[tuple]]:
    """Codes without holes, and the key of each."""
    used, dense = np.unique(code, return_inverse=True)
    return dense, [(*names[u // len(entries)], entries[u % len(entries)]) for u in used]


def combine(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Merge summaries (of partitions, days, ...) to one per group: ``groups..., sketch``."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; one sketch is held at a time."""
        key, whole, types = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), pa.array([whole.to_bytes()], pa.binary())], names=[*groups, "sketch"])

        for batch in batches:
            types = [batch.schema.field(g).type for g in groups]
            keys = zip(*(batch.column(batch.schema.get_field_index(g)).to_pylist() for g in groups))
            for k, raw in zip(keys, batch.column(batch.schema.get_field_index("sketch")).to_pylist()):
                if whole is not None and k == key:
                    whole.merge(RankSketch.from_bytes(raw))
                    continue
                if whole is not None:
                    yield out()
                key, whole = k, RankSketch.from_bytes(raw)
        if whole is not None:
            yield out()

    slim = sketches.select(*groups, "sketch")
    return slim.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(merge, slim.schema)


def percentiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Replace ``sketch`` by the number of values ``n`` and one column per share, e.g. ``{"median": 0.5}``."""
    names, wanted = list(shares), list(shares.values())

    @F.pandas_udf("struct<n: bigint, q: array<double>>")
    def read(raw: pd.Series) -> pd.DataFrame:
        got = [RankSketch.from_bytes(x) for x in raw]
        return pd.DataFrame({"n": [x.count for x in got], "q": [x.quantiles(wanted) for x in got]})

    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.withColumn("_r", read("sketch")).select(*rest, F.col("_r.n").alias("n"), *[F.col("_r.q")[i].alias(c) for i, c in enumerate(names)])
