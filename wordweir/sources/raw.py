"""Words of raw files, byte-exact, as a Spark data source.

A file is cut into byte ranges that tasks read on their own. A word belongs to the range in which it starts: a task looks at the
byte before its range to know whether it starts inside a word, and reads beyond the end to finish its last one. Files
are opened by the executors, by any address that ``files.store`` takes. With ``segmentBytes`` tasks count words by segment themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.scan import _GAP, find_words, word_array
from .files import FileError, regular, store

__all__ = ["FileError", "raw_counts", "raw_words", "regular_size"]

NAME = "raw_words"
RANGE_BYTES, BUFFER_BYTES = 128 << 20, 4 << 20
WORDS, COUNTS = "word binary, off bigint", "word binary, segment_id bigint, n bigint, first_off bigint"


def regular_size(path: str) -> int:
    """Size of a regular file; anything else is refused."""
    return regular(path).size


def range_words(path: str, start: int, end: int, buffer: int = BUFFER_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words that start in [start, end) and their offsets, a buffer at a time."""
    system, place = store(path)
    with system.open_input_file(place) as f:
        at = start
        inside = False  # of a word that belongs to the range before
        if start:
            f.seek(start - 1)
            before = f.read(1)
            inside = bool(before) and not _GAP[before[0]]
        held: list[bytes] = []  # a word that is not finished yet
        begun = at
        while True:
            piece = f.read(buffer if at >= end else min(buffer, end - at))
            if not piece:
                break
            data = np.frombuffer(piece, np.uint8)
            skip = 0
            if inside or held:
                gap = np.flatnonzero(_GAP[data])
                skip = int(gap[0]) if len(gap) else len(data)
                if held:
                    held.append(piece[:skip])
                if skip < len(data):
                    if held:
                        yield pa.array([b"".join(held)], pa.binary()), np.array([begun], np.int64)
                        held = []
                    inside = False
            if at < end:
                rest = data[skip:]
                starts, ends = find_words(rest, np.zeros(0, np.int64))
                if len(ends) and ends[-1] == len(rest):
                    begun, held = at + skip + int(starts[-1]), [piece[skip + int(starts[-1]) :]]
                    starts, ends = starts[:-1], ends[:-1]
                if len(starts):
                    yield word_array(rest, starts, ends, pa.binary()), at + skip + starts.astype(np.int64)
            at += len(piece)
            if at >= end and not held:
                break
        if held:
            yield pa.array([b"".join(held)], pa.binary()), np.array([begun], np.int64)


class Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class RawWordsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.buffer = int(options.get("bufferbytes", BUFFER_BYTES))
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", -1))
        self.segment = int(options.get("segmentbytes", 0))

    def partitions(self) -> list[Range]:
        size = regular_size(self.path)
        end = size if self.end < 0 else min(self.end, size)
        return [Range(a, min(end, a + self.step)) for a in range(self.start, end, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for word, off in range_words(self.path, partition.start, partition.end, self.buffer):
            if not self.segment:
                yield pa.RecordBatch.from_arrays([word, pa.array(off)], names=["word", "off"])
                continue
            # equal words of a buffer are combined before they go to the JVM
            found = pa.table({"word": word, "segment_id": pa.array(off // self.segment), "off": pa.array(off)}).group_by(["word", "segment_id"])
            found = found.aggregate([("off", "count"), ("off", "min")]).select(["word", "segment_id", "off_count", "off_min"])
            yield from found.rename_columns(["word", "segment_id", "n", "first_off"]).combine_chunks().to_batches()


class RawWords(DataSource):
    """Options: path, rangeBytes, bufferBytes, start, end (only words that start in [start, end)), segmentBytes (counts, not words)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if int(dict(self.options).get("segmentBytes", dict(self.options).get("segmentbytes", 0))) else WORDS

    def reader(self, schema) -> RawWordsReader:  # noqa: ANN001
        return RawWordsReader(dict(self.options))


def _read(spark: SparkSession, path: str, schema: str, range_bytes: int, buffer_bytes: int, start: int, end: int, segment_bytes: int) -> DataFrame:
    size = regular_size(path)
    if not size or start >= size or (0 <= end <= start):
        return spark.createDataFrame([], schema)
    spark.dataSource.register(RawWords)
    reader = spark.read.format(NAME).option("rangeBytes", range_bytes).option("bufferBytes", buffer_bytes).option("segmentBytes", segment_bytes)
    return reader.option("start", start).option("end", end).load(path)


def raw_words(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, buffer_bytes: int = BUFFER_BYTES, start: int = 0, end: int = -1) -> DataFrame:
    """(word binary, off) of a file. Refuses at once what is not a regular file."""
    return _read(spark, path, WORDS, range_bytes, buffer_bytes, start, end, 0)


def raw_counts(
    spark: SparkSession, path: str, segment_bytes: int, *, range_bytes: int = RANGE_BYTES, buffer_bytes: int = BUFFER_BYTES, start: int = 0, end: int = -1
) -> DataFrame:
    """(word binary, segment_id, n, first_off) of a file, partial counts by stretches of ``segment_bytes``."""
    return _read(spark, path, COUNTS, range_bytes, buffer_bytes, start, end, segment_bytes)
