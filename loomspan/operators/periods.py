"""Continuous covered periods and the gaps between them, by a two-level distributed sweep line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered_and_gaps(df: DataFrame, entity: list[str], left: str, right: str, *, block_bits: int = 20) -> DataFrame:
    """Maximal covered periods of closed integer intervals per entity, and the gaps between neighbours.

    Returns ``entity..., kind, lo, hi`` with ``kind`` in ``covered`` / ``gap``; intervals that overlap,
    touch or have no position between them form one period. Rows with a null entity, a null end or
    left > right don't take part; repeated rows change nothing; an empty table gives an empty result.

    Every interval becomes a plus event at ``left`` and a minus event at ``right + 1``. Events are summed
    per position, so a block of ``2**block_bits`` positions of one entity has a bounded number of them
    whatever the skew; a hot entity is spread over its blocks. Per block a prefix sum runs once; only
    block totals (one row per entity and block) are summed over the whole entity to give each block the
    number of intervals open at its start and the next boundary behind its end.
    """
    clash = {"_l", "_r", "_pos", "_d", "_block", "_s"} & set(entity)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    e = [F.col(c) for c in entity]
    usable = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) <= F.col(right))
    for c in entity:
        usable = usable & F.col(c).isNotNull()
    starts = (
        df.where(usable)
        .select(*e, F.col(left).cast("bigint").alias("_l"), (F.col(right).cast("bigint") + 1).alias("_r"))
        .groupBy(*entity, "_l")
        .agg(F.max("_r").alias("_r"))
    )
    both = F.explode(
        F.array(
            F.struct(F.col("_l").alias("p"), F.lit(1).alias("d")),
            F.struct(F.col("_r").alias("p"), F.lit(-1).alias("d")),
        )
    )
    # The join below needs a block that isn't null; said here, both its sides read the same shuffle.
    events = starts.select(*e, both.alias("_e")).select(
        *e,
        F.shiftright(F.col("_e.p"), block_bits).alias("_block"),
        F.col("_e.p").alias("_pos"),
        F.col("_e.d").alias("_d"),
    ).where("_block is not null")
    in_block = Window.partitionBy(*entity, "_block").orderBy("_pos")
    prefix = (
        events.repartition(*e, F.col("_block"))
        .groupBy(*entity, "_block", "_pos")
        .agg(F.sum("_d").alias("_d"))
        .withColumn("_s", F.sum("_d").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    )

    over_blocks = Window.partitionBy(*entity).orderBy("_block")
    after = Window.partitionBy(*entity).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        prefix.groupBy(*entity, "_block")
        .agg(
            F.sum("_d").alias("total"),
            F.min(F.struct("_s", "_pos")).alias("lowest"),
            F.min(F.when(F.col("_d") != 0, F.col("_pos"))).alias("first"),
        )
        .withColumn("_carry", F.coalesce(F.sum("total").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(
            "bound",
            F.when(F.col("_carry") == 0, F.col("first")).when(
                F.col("lowest._s") == -F.col("_carry"), F.col("lowest._pos")
            ),
        )
        .withColumn("_next", F.last("bound", ignorenulls=True).over(after))
        .select(*entity, "_block", "_carry", "_next")
    )
    active = F.col("_carry") + F.col("_s")
    return (
        prefix.join(blocks, [*entity, "_block"])
        .withColumn("_on", active > 0)
        .where((active > 0) != ((active - F.col("_d")) > 0))
        .withColumn("_hi", F.coalesce(F.lead("_pos").over(in_block), F.col("_next")) - 1)
        .where(F.col("_hi").isNotNull())
        .select(*e, F.when(F.col("_on"), "covered").otherwise("gap").alias("kind"), F.col("_pos").alias("lo"), F.col("_hi").alias("hi"))
    )


def depth_runs(df: DataFrame, entity: list[str], start: str, end: str, weight: str | None = None, *, block_bits: int = 20) -> DataFrame:
    """Coverage depth as runs ``entity..., start, end, value`` of half-open intervals [start, end); zero runs are left out.

    ``value`` is the number of intervals over a position, or the sum of their weights. Empty and reversed
    intervals and null ends don't count. The same two-level sweep as ``covered_and_gaps``: no position is
    expanded and no entity has to fit one task.
    """
    e = [F.col(c) for c in entity]
    w = F.col(weight).cast("double") if weight else F.lit(1)
    ends = F.array(F.struct(F.col(start).cast("bigint").alias("p"), w.alias("d")), F.struct(F.col(end).cast("bigint").alias("p"), (-w).alias("d")))
    events = df.where(F.col(start) < F.col(end)).select(*e, F.explode(ends).alias("_e")).groupBy(*entity, F.col("_e.p").alias("_pos")).agg(F.sum("_e.d").alias("_d"))
    blocked = events.withColumn("_block", F.shiftright("_pos", block_bits)).where("_block is not null").repartition(*e, F.col("_block"))
    inside = Window.partitionBy(*entity, "_block").orderBy("_pos")
    prefix = blocked.withColumn("_s", F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    over = Window.partitionBy(*entity).orderBy("_block")
    after = Window.partitionBy(*entity).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        prefix.groupBy(*entity, "_block")
        .agg(F.sum("_d").alias("t"), F.min("_pos").alias("first"))
        .withColumn("_carry", F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_next", F.last("first").over(after))
        .select(*entity, "_block", "_carry", "_next")
    )
    runs = prefix.join(blocks, [*entity, "_block"]).withColumn("end", F.coalesce(F.lead("_pos").over(inside), F.col("_next")))
    value = F.col("_carry") + F.col("_s")
    zero = F.abs(value) < 1e-9 if weight else value == 0
    return runs.where(~zero & F.col("end").isNotNull()).select(*e, F.col("_pos").alias("start"), "end", value.alias("value"))
