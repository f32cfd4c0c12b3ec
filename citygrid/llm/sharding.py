"""Sharding by longest-processing-time scheduling.

Groups that must stay together (here: equal texts) are placed in order of
falling size on the least-loaded shard, which a heap finds.

The list of groups grows with the corpus, so it is not what the heap sees. Groups
of at least ``total / bundles`` bytes (there can be at most ``bundles`` of them)
are items of their own; all lighter groups are hashed into ``bundles`` bundles,
each one item. The heap therefore handles at most ``2 * bundles`` items whatever the
corpus is, and two loads differ by little more than one light bundle unless a single
group is larger than a fair share.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lpt(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """``items``: (item, size). Equal sizes go in order of the item number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bundles: int = 8192, slot_buckets: int = 256
) -> DataFrame:
    """-> one row per row of ``docs``: id, size, text_crc32, law, shard, slot.

    ``size`` is the UTF-8 length plus 1 (null text: 1). Null texts form one group, the
    empty text another. Rows with a null or repeated id are placed like any other.
    Slots run from 0 without gaps in each shard; they are numbered inside
    ``slot_buckets`` hash buckets per shard and shifted by the buckets' counts, so no
    window holds a shard. An empty table gives an empty table. Other columns of
    ``docs`` are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("grp"),
    )
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)).first()[0] or 0
    heavy_from = max(1, -(-total // bundles))
    bundle = F.pmod(F.xxhash64("grp"), F.lit(bundles)).cast("long")

    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    item = F.when(F.col("bytes") >= heavy_from, F.col("grp")).otherwise(F.concat(F.lit("bundle "), bundle))
    found = groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).orderBy("item").collect()  # at most 2 * bundles rows
    placed = lpt([(k, r["bytes"]) for k, r in enumerate(found)], shards)
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("shard", T.IntegerType())])
    spark = docs.sparkSession
    plan = [(r["item"], placed[k]) for k, r in enumerate(found)]
    heavy = spark.createDataFrame([p for p in plan if not p[0].startswith("bundle ")], schema)
    light = spark.createDataFrame([p for p in plan if p[0].startswith("bundle ")], schema)

    dealt = (
        rows.join(F.broadcast(heavy.select(F.col("item").alias("grp"), F.col("shard").alias("heavy_shard"))), "grp", "left")
        .withColumn("item", F.concat(F.lit("bundle "), bundle))
        .join(F.broadcast(light), "item", "left")
        .select(
            id_col, "size", "text_crc32", F.coalesce("heavy_shard", "shard").alias("shard"),
            F.pmod(F.xxhash64(id_col, "size", "text_crc32", F.lit(7)), F.lit(slot_buckets)).alias("bucket"),
        )
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "bucket").count()
        .withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select("shard", "bucket", "first")
    )
    within = Window.partitionBy("shard", "bucket").orderBy(id_col, "text_crc32", "size")
    return (
        dealt.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])  # shards * slot_buckets rows
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
    )
