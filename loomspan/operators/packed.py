"""Several values packed in one text field, split by scanning Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomspan.session import chunks, column

QUOTE, SINGLE, OPEN, CLOSE, SLASH = (ord(c) for c in "\"'[]/")
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n\v\f"]] = True
_HARD = np.zeros(256, bool)
_HARD[[ord(c) for c in ",;|"]] = True
_BRACKET = np.zeros(256, bool)
_BRACKET[[OPEN, CLOSE]] = True


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """String array of the byte ranges [start, end) of ``data``."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[take].tobytes()))
    return flat


def split_packed(texts: pa.Array, blanks_split: bool) -> pa.LargeListArray:
    """List of values per text; null and empty texts give empty lists.

    Delimiters are ``, ; |``, a slash between blanks and, if ``blanks_split``, blanks. Delimiters within
    double quotes don't split, nor within single quotes in a text that opens with a bracket. An empty
    stretch between delimiters opens no value unless it was quoted. An unclosed quote runs to the end.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    count = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + count + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    size = len(data)
    if not size:
        return pa.LargeListArray.from_arrays(pa.array(np.zeros(count + 1, np.int64)), pa.array([], pa.large_string()))
    begin, end = bounds[:-1], bounds[1:]
    owner = np.repeat(np.arange(count), end - begin)

    def inside(mark: np.ndarray) -> np.ndarray:
        """True from an opening mark to just before its closing one."""
        seen = np.concatenate([[0], np.cumsum(mark)])
        return ((seen[1:] - seen[begin[owner]]) & 1).astype(bool)

    double = inside(data == QUOTE)
    bracketed = np.zeros(count, bool)
    full = end > begin
    solid = np.where(_BLANK[data], size, np.arange(size))
    following = np.minimum.accumulate(solid[::-1])[::-1]
    first = following[begin[full]]
    bracketed[full] = (first < end[full]) & (data[np.minimum(first, size - 1)] == OPEN)
    single = inside((data == SINGLE) & ~double & bracketed[owner])
    closing = (data == QUOTE) | ((data == SINGLE) & bracketed[owner] & ~double)
    quoted = double | single

    before, behind = np.roll(_BLANK[data], 1), np.roll(_BLANK[data], -1)
    split = (_HARD[data] | ((data == SLASH) & before & behind)) & ~quoted
    if blanks_split:
        split |= _BLANK[data] & ~quoted
    at = np.flatnonzero(split)
    opened = np.concatenate([at + 1, begin])  # at a tie the empty stretch that ends a row comes before the next row
    order = np.argsort(opened, kind="stable")
    start = opened[order]
    stop = np.sort(np.concatenate([at, end]), kind="stable")
    row = np.concatenate([owner[at], np.arange(count)])[order]

    def trim(start: np.ndarray, stop: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.arange(size)
        to_right = np.minimum.accumulate(np.where(drop, size, index)[::-1])[::-1]
        to_left = np.maximum.accumulate(np.where(drop, -1, index))
        some = stop > start
        a, b = start.copy(), stop.copy()
        a[some] = np.minimum(to_right[start[some]], stop[some])
        b[some] = np.maximum(to_left[stop[some] - 1] + 1, a[some])
        return a, b

    start, stop = trim(start, stop, (_BLANK[data] | _BRACKET[data]) & ~quoted & ~closing)
    wide = stop - start >= 2
    head, tail = data[np.minimum(start, size - 1)], data[np.maximum(stop - 1, 0)]
    marked = wide & (head == tail) & closing[np.minimum(start, size - 1)] & ((head == QUOTE) | (head == SINGLE))
    start, stop = start + marked, stop - marked
    start, stop = trim(start, stop, _BLANK[data])
    keep = (stop > start) | marked
    start, stop, row, marked = start[keep], stop[keep], row[keep], marked[keep]
    values = _gather(data, start, stop)
    if marked.any():
        doubled = pc.and_(pa.array(marked), pc.match_substring(values, '""'))
        if pc.any(doubled).as_py():
            values = pc.if_else(doubled, pc.replace_substring(values, '""', '"'), values)
    offsets = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=count), out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), values)


PACKED = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("item", T.StringType()),
    ]
)


def unpack_fields(df: DataFrame, id_col: str, fields: dict[str, bool], *, least: int = 2, chunk_rows: int = 50_000) -> DataFrame:
    """One row per value of each field: ``field_name, row_id, pos, item``; ``pos`` counts from 1.

    ``fields`` maps a string column to whether blanks split it. Only fields with at least ``least``
    values give rows; null and blank fields give none; repeated values and rows stay. Narrow: no
    shuffle, one pass over the Arrow buffers of each input partition.
    """
    names = dict(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(iter(batches), chunk_rows):
            ids = column(table, "row_id")
            for name, blanks_split in names.items():
                lists = split_packed(column(table, name), blanks_split)
                counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                parent = pc.list_parent_indices(lists)
                parents = parent.to_numpy(zero_copy_only=False)
                first = np.cumsum(counts) - counts
                pos = np.arange(len(parents)) - first[parents] + 1
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array([name], pa.string()).take(pa.array(np.zeros(len(parents), np.int64))),
                        ids.take(parent),
                        pa.array(pos.astype(np.int32)),
                        lists.flatten().cast(pa.string()),
                    ],
                    names=PACKED.names,
                )
                yield out.filter(pa.array(counts[parents] >= least))

    return df.select(df[id_col].cast("bigint").alias("row_id"), *[df[c] for c in fields]).mapInArrow(run, PACKED)
