"""Weighted rendezvous sharding with gapless slots, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import hash_bucket, id_key, saved

#: Copies of one row that one task numbers at most.
BLOCK = 10_000


def rendezvous(key: Column, weights: Mapping[int, float], seed: str = "shard") -> Column:
    """The shard with the highest score -weight / ln(u), u in (0, 1) from the MD5 of seed, shard and key.

    A shard's score does not depend on the other shards, so a new shard only takes keys for itself, a removed
    shard only gives its own away, and a changed weight moves keys only to or from its shard.
    """
    scores = []
    for shard, weight in sorted(weights.items()):
        digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key))
        unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(unit)).alias("score"), F.lit(int(shard)).alias("shard")))
    if len(scores) == 1:
        return scores[0]["shard"]
    return F.array_max(F.array(*scores))["shard"]


def shard_documents(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], *, seed: str = "shard") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, grown_shard and slot, gapless from 0 in each shard.

    shard is by `weights`, grown_shard by `grown`. size is the text's UTF-8 bytes plus 1; a null text has size 1 and
    checksum 0, as the empty one. A null doc_id has the empty key. Repeated rows share a shard and get slots of their
    own. Other columns of docs are not read. An empty table gives no rows.

    Slots follow (bucket, doc_id, checksum, size): each shard is cut into 4096 hash buckets, numbered apart and then
    moved by the sums of the buckets before, so no task orders a whole shard.
    """
    key, raw = id_key(F.col("doc_id")), F.col("text").cast("binary")
    rows = (
        docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"shard": rendezvous(key, weights, seed).cast("int"), "grown_shard": rendezvous(key, grown, seed).cast("int"), "bucket": hash_bucket(key)})
    )
    rows = saved(rows, "shard-rows")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("in_bucket")).select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(starts, ["shard", "bucket"])
    placed = placed.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {BLOCK})")))
    placed = placed.withColumn("copy", F.explode(F.expr(f"sequence(block * {BLOCK}, least(copies, (block + 1) * {BLOCK}) - 1)")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("bucket_start") + F.col("start") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
