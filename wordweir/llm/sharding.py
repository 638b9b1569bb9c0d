"""Sharding by a two-pass external shuffle, in DataFrame functions only.

The shard of a record is that of the highest of its seeded hashes with each shard number (so one more shard takes
records only into itself). First pass: records are scattered uniformly, by a seeded hash of their row number, into buckets
of their shard that fit in memory; how many follows from each shard's own bytes, and no bucket may turn out much larger
(then its shard gets more). Each bucket is one task. Second pass: each bucket is Fisher-Yates shuffled by itself
and gets its place after the shard's earlier buckets, whose sizes are summed beforehand.

As rows are scattered by their number and not by what they hold, any number of equal rows spread over the buckets. Row numbers must be
the same whenever a row is read: ``docs`` is a table, or has been cut.

Defined cases: null text has no bytes; null ids are one key, so one shard; equal rows are records of their own; no rows give no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, BUCKET_BYTES, SEED = 8, 16 << 20, 2024
#: What stands for a null id.
NO_KEY = "~"


def highest_hash(key: Column, shards: int, seed: int = SEED) -> Column:
    """Number of the shard whose hash with the key is highest (of equal ones: the highest number)."""
    text = F.coalesce(key.cast("string"), F.lit(NO_KEY))
    # one expression over the shard numbers, not one for each: generated code stays small
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    ranks = F.transform(numbers, lambda s: F.struct(F.md5(F.concat(text, F.lit(f":{seed}:"), s.cast("string"))).alias("h"), s.alias("s")))
    return F.array_max(ranks)["s"]


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _of(numbers: list[int], shard: str) -> Column:
    return F.get(F.array(*map(F.lit, numbers)), F.col(shard))


def shuffle_into_shards(
    docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
) -> DataFrame:
    """Columns of ``docs`` as the struct ``record``, with shard, grown_shard, bucket and slot (its place in the shard)."""
    numbered = docs.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("row"))
    numbered = numbered.withColumn("shard", highest_hash(F.col("record")[id_col], shards, seed))
    size = record_bytes(F.col("record")[text_col])
    total, largest = [0] * shards, 0
    for r in numbered.groupBy("shard").agg(F.sum(size).alias("bytes"), F.max(size).alias("largest")).collect():
        total[r["shard"]], largest = r["bytes"], max(largest, r["largest"])
    buckets = [max(1, -(-b // bucket_bytes)) for b in total]
    while True:
        dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("row")), _of(buckets, "shard")).cast("int"))
        sizes = cut(dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")))
        # a bucket holds its mean, twice that by chance, and one record of any size
        over = [r["shard"] for r in sizes.where(F.col("bytes") > 2 * bucket_bytes + largest).select("shard").distinct().collect()]
        if not over:
            break
        buckets = [2 * n if s in over else n for s, n in enumerate(buckets)]
    first = [sum(buckets[:s]) for s in range(shards)]
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one bucket for each task, by its number; its place comes to it as a row of its own, so nothing is joined
    task = (_of(first, "shard") + F.col("bucket")).cast("int").alias("task")
    place = F.struct("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    one = F.struct(F.xxhash64(F.lit(seed + 2), F.col("row")).alias("h"), "record")
    records = dealt.select(task, one.alias("one"), F.lit(None).cast("struct<shard:int,bucket:int,base:bigint>").alias("place"))
    places = sizes.select(task, F.lit(None).cast(records.schema["one"].dataType).alias("one"), place.alias("place"))
    scattered = records.unionByName(places).repartitionById(sum(buckets), F.col("task"))
    piled = scattered.groupBy("task").agg(F.collect_list("one").alias("pile"), F.first("place", ignorenulls=True).alias("place"))
    # a fixed order first, so that the shuffle does not depend on the order of arrival
    order = F.array_sort("pile", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    mixed = piled.select("place.*", F.shuffle(order, seed).alias("pile"))
    spread = mixed.select("shard", "bucket", "base", F.posexplode("pile").alias("at", "one"))
    grown = highest_hash(F.col("one.record")[id_col], shards + 1, seed)
    return spread.select("one.record", "shard", grown.alias("grown_shard"), "bucket", (F.col("base") + F.col("at")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, files in the order of their buckets."""
    sharded.select("record.*", "shard", "slot").write.partitionBy("shard").parquet(path)
