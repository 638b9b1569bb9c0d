"""Profiles as Parquet, and runs that can be resumed.

A run works in a folder: ``identity`` says what the input is, ``segments/<first>-<last>`` hold the profiles of a wave of segments, ``profile``
is the merge of all. A wave is one job over all its segments, and all waves are merged by one read. Each folder is written by
Spark's commit protocol and counts only once its success mark is there; an unfinished one is
written anew as a whole. So a resumed run sees every byte exactly once, wherever the one before was stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P


class RunError(ValueError):
    """The folder holds a run over another input."""


def write_profile(profile: DataFrame, path: str) -> None:
    """Sorted by word within each file, so that readers can skip by word and by ``repeated``."""
    profile.sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(place))


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


#: Segments of a job: what is done again at most if a run is stopped.
WAVE = 1024


class Run:
    """A resumable profile of something that can be cut into segments.

    ``identity`` describes the input (name, size, time ...); ``counts(start, end)`` gives the partial (word, segment_id, n, first_off)
    rows of the stretch [start, end), which is some whole segments.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: str, wave: int = WAVE) -> None:
        self.spark, self.folder, self.wave = spark, folder.rstrip("/"), wave
        identity = f"{identity} in waves of {wave}"
        path = f"{self.folder}/identity"
        if committed(spark, path):
            known = spark.read.parquet(path).first()["identity"]
            if known != identity:
                raise RunError(f"{folder} holds a run over {known}, not {identity}")
        else:
            spark.createDataFrame([(identity,)], "identity string").coalesce(1).write.mode("overwrite").parquet(path)

    def waves(self, n: int) -> list[tuple[int, int, str]]:
        """First segment, end and folder of each wave of n segments."""
        ends = [(a, min(n, a + self.wave)) for a in range(0, n, self.wave)]
        return [(a, b, f"{self.folder}/segments/{a:09d}-{b - 1:09d}") for a, b in ends]

    def profile_segments(self, counts: Callable[[int, int], DataFrame], size: int, segment_bytes: int) -> int:
        """Writes the waves that are missing; the number of segments."""
        return self.store_segments(lambda a, b: P.finish(counts(a, b), ["segment_id"]), size, segment_bytes)

    def store_segments(self, profiles: Callable[[int, int], DataFrame], size: int, segment_bytes: int) -> int:
        """The same from finished profiles of segments: ``profiles(start, end)``."""
        n = max(1, -(-size // segment_bytes))
        for a, b, path in self.waves(n):
            if not committed(self.spark, path):
                write_profile(profiles(a * segment_bytes, min(size, b * segment_bytes)), path)
        return n

    def segments(self) -> DataFrame:
        """The profiles of all segments, with their segment_id."""
        return read_profile(self.spark, f"{self.folder}/segments/*")

    def merge(self, n: int, keep: bool = False) -> DataFrame:
        """The merge of all n segments, stored; the segments go afterwards unless they are to be kept."""
        path = f"{self.folder}/profile"
        if not committed(self.spark, path):
            missing = [p for *_, p in self.waves(n) if not committed(self.spark, p)]
            if missing:
                raise RunError(f"not profiled yet: {missing[0]}")
            write_profile(P.merge(self.segments()), path)
        if not keep:
            remove(self.spark, f"{self.folder}/segments")
        return read_profile(self.spark, path)

    @property
    def merged(self) -> bool:
        return committed(self.spark, f"{self.folder}/profile")


def manifest(segments: DataFrame, segment_bytes: int, size: int) -> DataFrame:
    """(segment_id, start, end, words, profile_bytes) of a run's stored segments; ``end`` is the last byte. Segments without words have no row."""
    start = F.col("segment_id") * segment_bytes
    end = F.least(start + segment_bytes, F.lit(size)) - 1
    return P.segment_statistics(segments).select("segment_id", start.alias("start"), end.alias("end"), "words", "profile_bytes")
