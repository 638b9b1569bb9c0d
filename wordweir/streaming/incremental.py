"""A profile that follows a folder of text tables.

The state is one count and one first place per word; as uniqueness is global, no watermark can drop any. The place is the pair
(key, position in the text), which orders as byte offsets do but needs no sum over rows that have not come yet. Each trigger
processes what is new, exactly once by the checkpoint; a stopped query goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


#: Triggers between two compactions.
COMPACT_EVERY = 16
ROWS = "word string, n bigint, repeated boolean, first struct<key:bigint,pos:int>"


def word_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, key, pos) from built-in functions; works on streams and tables alike."""
    tokens = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]", -1)).alias("pos", "word"))
    return tokens.where("word <> ''").select("word", "key", "pos")


def running_profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, repeated, first: key and pos)."""
    found = word_places(docs, key, text).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("first"))
    return found.select("word", "n", (F.col("n") > 1).alias("repeated"), "first")


def follow_to_table(
    spark: SparkSession, folder: str, schema: StructType, checkpoint: str, out: str, *, files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Processes what the folder of Parquet files has that is new, and stops.

    Each trigger's changed words are written as Parquet under ``out``/batch=<k>; ``latest`` reads them. Nothing comes to the driver. After every
    ``compact_every`` triggers the newest rows of all words are written as one batch, and what came before is deleted.
    """

    def write(changed: DataFrame, k: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={k}")
        if k % compact_every == compact_every - 1:
            compact(spark, out, k)

    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    profile = running_profile(reader.parquet(folder))
    return profile.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, out: str) -> dict[int, str]:
    """The finished batches of ``out`` by their number."""
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return {int(n.removeprefix("batch=").removesuffix("-all")): f"{out}/{n}" for n in sorted(done)}


def compact(spark: SparkSession, out: str, k: int) -> None:
    """Batches up to k as one, ``batch=<k>-all``; a trigger that is done again writes and compacts the same."""
    found = _batches(spark, out)
    latest(spark, out).write.mode("overwrite").parquet(f"{out}/batch={k}-all")
    for n, path in found.items():
        if n <= k and path != f"{out}/batch={k}-all":
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The profile after the last trigger: each word's newest row, which has the largest count."""
    found = list(_batches(spark, out).values())
    if not found:
        return spark.createDataFrame([], ROWS)
    rows = spark.read.parquet(*found)
    return rows.groupBy("word").agg(F.max(F.struct("n", "repeated", "first")).alias("r")).select("word", "r.*")
