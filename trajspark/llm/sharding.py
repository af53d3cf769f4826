"""Sharding by rendezvous hashing: each record key ranks all shards, the best rank wins.

A key's rank of a shard depends on the key and that shard only, so a further
shard takes rows only into itself: about weight / total weight of them.
Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of one numbering task aimed at; a bucket of a shard is numbered by one task
ROWS_PER_BUCKET = 200_000


def key_text(key: str) -> Column:
    """The stable record key as text; null keys share one text that no value has."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0..len(weights)-1 of a key text.

    u in (0, 1) comes from the first 48 bits of md5("key|shard"); the shard with the
    smallest -ln(u) / weight wins (an exponential race, so shares follow the weights);
    ties go to the lower shard. A weight of 0 takes nothing.
    """
    races = []
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("weights must not be negative")
        if weight:
            bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, 12), 16, 10).cast("double")
            cost = -F.log((bits + 0.5) / float(2**48)) / float(weight)
            races.append(F.struct(cost.alias("cost"), F.lit(shard).alias("shard")))
    if not races:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*races))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", n_rows: int | None = None) -> DataFrame:
    """Shard of every row, its gapless slot in the shard, and its shard under ``grown`` weights.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32,
    law, shard, slot (from 0 in each shard, without gaps), grown_shard (null without
    ``grown``). Further columns of the input are not carried, so their names don't
    matter. Null keys go to one shard; an empty table gives an empty result; repeated
    rows are all numbered, and which of several identical rows has which slot is open.

    Numbering: rows of a shard are dealt to buckets by a hash of the whole record,
    numbered inside the bucket, and moved by the counts of the shard's buckets before.
    One bucket holds about ``ROWS_PER_BUCKET`` rows however large a shard is. The
    table of bucket counts (shards x buckets rows) is joined, not collected.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        key_text(key).alias("key"),
    )
    n = n_rows if n_rows is not None else docs.select(key).count()
    buckets = max(1, -(-n // (ROWS_PER_BUCKET * len(weights))), _partitions(docs) // max(1, len(weights)))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        rendezvous(F.col("key"), weights).alias("shard"),
        (rendezvous(F.col("key"), grown) if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"
    )


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
