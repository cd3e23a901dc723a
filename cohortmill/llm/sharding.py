"""Two-pass external shuffle into shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.functions.scale import BROADCAST_ROWS
from cohortmill.llm.rows import new_path, text_of

BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 50_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Shard by highest seeded hash: with one more shard a row stays or moves into the new one. A null key has a shard too."""
    return F.array_max(F.array(*[
        F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("weight"), F.lit(i).alias("shard")) for i in range(shards)
    ])).getField("shard")


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 17, path: str | None = None, key: str = "doc_id", text: str = "text",
                   bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shuffle all rows into ``shards`` and write them as Parquet under ``path`` (partitioned by shard).

    Pass one scatters rows with seeded hashes into buckets of about ``bucket_bytes`` and at most about ``bucket_rows``
    (within a shard); repeated rows are spread too, for the bucket also depends on the row's place in the input. Pass two
    brings a bucket together, puts it in a fixed order and applies a seeded Fisher-Yates shuffle (``shuffle``).
    A bucket is the only thing that one task holds.

    Returns the input columns plus ``_size`` (UTF-8 bytes plus one), ``_shard``, ``_slot`` (gapless from 0 in each shard)
    and ``_grown`` (shard if there were one more). Null key: hashed as such. Null text: size 1. Empty table: no rows.
    Input columns of these names, or with other clashing names, travel inside a struct; own columns win only in the result.
    """
    spark = docs.sparkSession
    size = F.octet_length(text_of(text)).cast("long") + 1
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(1, math.ceil(total["bytes"] / (shards * bucket_bytes)), math.ceil(total["rows"] / (shards * bucket_rows)))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), size.alias("_size"),
        shard_of(F.col(key), shards, seed).alias("_shard"), shard_of(F.col(key), shards + 1, seed).alias("_grown"),
        F.monotonically_increasing_id().alias("_at"),
    ).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(f"r.`{key}`"), F.col("_at")), F.lit(buckets)).cast("int"))
    dealt = (
        rows.repartition(shards * buckets, "_shard", "_bucket").groupBy("_shard", "_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_size", "_grown", "r"))).alias("a"))
        .sortWithinPartitions("_shard", "_bucket")
        .select("_shard", "_bucket", F.posexplode(F.shuffle("a", F.lit(seed))).alias("_pos", "x"))
        .select("_shard", "_bucket", "_pos", "x._size", "x._grown", "x.r")
    )
    path = path or new_path(spark, "shards")
    dealt.write.option("compression", "zstd").partitionBy("_shard").parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    sizes = written.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    if shards * buckets <= BROADCAST_ROWS:  # one row per bucket, so the size is known; the written rows need not move again
        offsets = F.broadcast(offsets)
    own = ("_size", "_shard", "_slot", "_grown")
    return written.join(offsets, ["_shard", "_bucket"]).select(
        *[F.col(f"r.`{c}`") for c in docs.columns if c not in own],
        "_size", "_shard", (F.col("_offset") + F.col("_pos")).alias("_slot"), "_grown",
    )
