"""Connected components of a star-shaped link table, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import checkpointed

#: So many jumping labels are broadcast (16 bytes each).
FEW = 200_000
SALTS = 16


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component``: smallest node id of each component; only linked nodes appear.

    ``links`` are undirected pairs of BIGINT ids; nulls and self links are allowed. Every round a hub takes
    the smallest label of its members (combined before the shuffle), members take their hubs' smallest
    label, and labels jump to their label's label, so that rounds grow with the logarithm of a chain. Only
    labels that jump are joined: broadcast while they are few, else with salted keys, as a giant component's
    members share one label. Labels only fall, so it ends. Nothing is collected; lineage is cut every round.
    """
    pairs = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).distinct()
    pairs = checkpointed(pairs)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    labels = checkpointed(nodes.distinct().select("node", F.col("node").alias("component")))
    while True:
        at_u = pairs.join(labels.select(F.col("node").alias("u"), F.col("component").alias("lu")), "u")
        hubs = at_u.groupBy("v").agg(F.min("lu").alias("c")).select(F.col("v").alias("node"), "c")
        at_v = pairs.join(labels.select(F.col("node").alias("v"), F.col("component").alias("lv")), "v")
        members = at_v.groupBy("u").agg(F.min("lv").alias("c")).select(F.col("u").alias("node"), "c")
        own = labels.select("node", F.col("component").alias("c"), F.col("component").alias("before"))
        told = own.unionByName(hubs.unionByName(members).withColumn("before", F.lit(None).cast("bigint")))
        lower = checkpointed(told.groupBy("node").agg(F.min("c").alias("c"), F.max("before").alias("before")))
        jump = lower.where("c < node").select(F.col("node").alias("c"), F.col("c").alias("further"))
        jump = jump.join(lower.select("c").distinct(), "c", "left_semi")
        if jump.count() <= FEW:
            onward = lower.join(F.broadcast(jump), "c", "left")
        else:
            salted = lower.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
            onward = salted.join(jump.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["c", "salt"], "left")
        labels = checkpointed(onward.select("node", F.coalesce("further", "c").alias("component"), "before"))
        if labels.where("component <> before").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
