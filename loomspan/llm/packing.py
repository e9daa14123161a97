"""Documents into containers of fixed capacity: Martello-Toth dominance, then best fit.

Lengths are whole numbers up to the capacity, so the whole instance is a table of counts per length: its
size is bounded by the capacity, whatever the number of documents. The plan (which lengths share a
container, and how many such containers) is made on that table on the driver; documents are then dealt
out to the planned places by their number within their length, in parallel.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import checkpointed, chunks, column

#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, id_col: str, text: str, vocabulary: str) -> DataFrame:
    """``id, tokens`` of every document that isn't blank, by the public byte-level vocabulary at ``vocabulary``.

    The vocabulary is a file of the driver; it is sent to the workers. Null ids and null texts give no row.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(name))
        for table in chunks(iter(batches), 1000):
            sizes = [len(encoding.encode_ordinary(t)) for t in column(table, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(table, "id"), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    blank = F.regexp_replace(F.col(text), r"[\s ]+", "") == ""
    some = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & ~blank)
    return some.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, tokens bigint")


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers as (lengths, how many), for ``counts`` documents of each length.

    Dominance first, on the largest length j each time: a length that fills j's container exactly can't be
    bettered; if the largest partner that fits leaves no room that two smaller ones could use better, the
    pair dominates all sets with j; if nothing fits, j stands alone. Those containers are fixed for good.
    What remains goes best fit decreasing, all documents of a length and all containers of a rest at once.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    sizes = sorted(left)  # not looked at yet
    passed: list[int] = []  # lengths without a dominating set: to best fit
    fixed: dict[tuple[int, ...], int] = {}
    open_by_rest: dict[int, dict[tuple[int, ...], int]] = {}

    def use(length: int, times: int) -> None:
        left[length] -= times
        if not left[length]:
            del left[length]
            side = sizes if sizes and length <= sizes[-1] else passed
            del side[bisect.bisect_left(side, length)]

    def fix(items: tuple[int, ...], times: int) -> None:
        fixed[items] = fixed.get(items, 0) + times
        for length in set(items):
            use(length, times * items.count(length))

    while sizes:
        j = sizes[-1]
        room = capacity - j
        side = passed if passed and passed[0] <= room else sizes  # lengths passed over are larger than j
        at = bisect.bisect_right(side, room) - 1
        if at < 0 or (side[at] == j and left[j] == 1 and len(sizes) == 1):
            fix((j,), left[j])
            continue
        partner = side[at] if side[at] != j or left[j] > 1 else sizes[-2]
        first = sizes[0]
        two = 2 * first if left[first] > (2 if first == j else 1) else first + sizes[1] if len(sizes) > 1 else capacity + 1
        if partner == room or two > room:  # an exact fill, or only one item fits beside j: the largest partner dominates
            fix((j, partner), left[j] // 2 if partner == j else min(left[j], left[partner]))
        else:
            bisect.insort(passed, sizes.pop())

    waiting = {length: left[length] for length in passed}
    rests: list[int] = []

    def opened(items: tuple[int, ...], times: int) -> None:
        rest = capacity - sum(items)
        if rest not in open_by_rest:
            open_by_rest[rest] = {}
            bisect.insort(rests, rest)
        open_by_rest[rest][items] = open_by_rest[rest].get(items, 0) + times

    for items, times in fixed.items():
        opened(items, times)  # room beside fixed sets is still offered to the remainder
    for length in sorted(waiting, reverse=True):
        todo = waiting[length]
        while todo:
            at = bisect.bisect_left(rests, length)
            if at == len(rests):
                each = capacity // length
                full, more = divmod(todo, each)
                if full:
                    opened((length,) * each, full)
                if more:
                    opened((length,) * more, 1)
                break
            rest = rests[at]
            items, times = next(iter(open_by_rest[rest].items()))
            each = min(rest // length, todo)  # so many of this length in one container
            take = min(times, max(1, todo // each))
            del open_by_rest[rest][items]
            if not open_by_rest[rest]:
                del open_by_rest[rest]
                del rests[at]
            if times > take:
                opened(items, times - take)
            opened(items + (length,) * each, take)
            todo -= each * take
    merged: dict[tuple[int, ...], int] = {}
    for group in open_by_rest.values():
        for items, times in group.items():
            key = tuple(sorted(items, reverse=True))
            merged[key] = merged.get(key, 0) + times
    return sorted(merged.items(), reverse=True)


def fill_containers(lengths: DataFrame, *, capacity: int = 2048, id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """``id, part, first_token, tokens, container, place``: where every document, or part of a longer one, goes.

    A document is split only if it is longer than the capacity: into full parts and a rest, each an item of
    its own (full parts fill a container). Null ids, null or non-positive lengths don't take part. Every
    item is placed once and no container holds more than ``capacity`` tokens. Containers count from 0.
    """
    usable = lengths.where(F.col(id_col).isNotNull() & (F.col(tokens) > 0)).select(F.col(id_col).alias("id"), F.col(tokens).cast("bigint").alias("t"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t") - 1) / capacity))
    items = usable.select("id", "t", F.explode(parts).alias("part")).select(
        "id", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("t") - F.col("part") * capacity).alias("tokens")
    )
    items = checkpointed(items.withColumn("chunk", F.spark_partition_id()))
    spark = lengths.sparkSession
    per_chunk = checkpointed(items.groupBy("tokens", "chunk").agg(F.count(F.lit(1)).alias("n")))
    counts = {int(r[0]): int(r[1]) for r in per_chunk.groupBy("tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows, first = [], 0
    seen: dict[int, int] = {}
    for number, (lengths_in, times) in enumerate(plan_containers(counts, capacity)):
        for place, length in enumerate(lengths_in):
            start = seen.get(length, 0)
            rows.append((length, start, start + times, first, place))
            seen[length] = start + times
        first += times
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["tokens", "from_rank", "to_rank", "first_container", "place"]) if rows else [], "tokens bigint, from_rank bigint, to_rank bigint, first_container bigint, place int")

    # The number of an item within its length: items of earlier chunks of the same length, then its number in the chunk.
    before = Window.partitionBy("tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_chunk.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("tokens", "chunk").orderBy("id", "part")
    ranked = items.withColumn("k", F.row_number().over(within) - 1).join(offset, ["tokens", "chunk"]).withColumn("rank", F.col("k") + F.col("offset"))
    # A plan row covers a range of ranks of one length; ranges are cut at multiples of `step` for an equi-join.
    step = 1 << 10  # few rows of the plan meet in a slot
    cut = plan.withColumn("slot", F.explode(F.sequence(F.floor(F.col("from_rank") / step), F.floor((F.col("to_rank") - 1) / step))))
    return (
        ranked.withColumn("slot", F.floor(F.col("rank") / step))
        .join(cut, ["tokens", "slot"])
        .where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .select("id", "part", "first_token", "tokens", (F.col("first_container") + F.col("rank") - F.col("from_rank")).alias("container"), "place")
    )
