"""Helpers shared by the corpus operators: tables, checkpoints and byte-level words."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are a digit, a letter a-z or above 0x7F, after A-Z are lower-cased.
#: The table maps a byte to its lower-cased self, or to a space if it parts words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a vectorised step handles at once; its temporaries are a few dozen times as large.
SLICE_BYTES = 1 << 18

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named (tests), a temporary one is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordweir-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``cut`` table that nothing reads any more (best effort)."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of more than one row in so many are hot: there are at most so many of them, so they may be broadcast.
HOT = 10_000
LEAST_HOT = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with a table (cut) of one row a key, whose ``size`` is the key's number of rows; ``total`` is their sum.

    Hot keys (at most HOT) are broadcast, so that none of their rows is shuffled; the others are joined by a shuffle.
    """
    least = max(LEAST_HOT, total // HOT)
    if table.where(F.col("size") > least).isEmpty():
        return rows.join(table, key, how)
    hot = F.broadcast(table.where(F.col("size") > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("size") <= least), key, how)
    return rows.join(hot, key).unionByName(cold)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used (also inside a lambda)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_held: dict[str, tuple[object, object]] = {}


def held(kind: str, key: object, build: Callable[[], object]) -> object:
    """What a Python worker builds once and keeps for its later tasks: one thing at a time, so that stages do not add up."""
    if kind not in _held or _held[kind][0] != key:
        _held.clear()
        release()
        _held[kind] = key, build()
    return _held[kind][1]


def release() -> None:
    """Give memory that is free back to the system (best effort: workers live long and share an executor's bound)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def let_go() -> None:
    """Forget what an earlier stage held in this worker."""
    if _held:
        _held.clear()
        release()


def released(step: Callable[[Iterator], Iterator], holds: bool = False) -> Callable[[Iterator], Iterator]:
    """The step of a mapInArrow, with ``release`` after each partition; unless it ``holds`` something itself, nothing held goes through it."""

    def run(parts: Iterator) -> Iterator:
        if not holds:
            let_go()
        yield from step(parts)
        release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_LUT = np.frombuffer(WORD_BYTES, np.uint8)
#: A random number for each of a word's first places and each byte; a place further on is mixed in.
PLACES = 64
_LETTERS = mix(np.arange(1, PLACES * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def letters(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Numbers whose sum over a word hashes it: each letter is mixed with its place, so that no pattern of letters cancels out."""
    value = _LETTERS[(place & (PLACES - 1)) * 256 + byte]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value[far] = mix(value[far] + (place[far] // PLACES).astype(U) * U(0xD1342543DE82EF95))
    return value


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts that lie one after another in ``data``.

    ``starts`` are the texts' first bytes. Returns a 64-bit hash for each word, and each text's number of words.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(len(starts), np.int64)
    low = _LUT[data]
    word = low != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = starts[starts < len(data)]
    first[edge] = word[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(starts), np.int64)
    chars = np.flatnonzero(word)
    begin = np.searchsorted(chars, at)
    sizes = np.diff(np.append(begin, len(chars)))
    place = np.arange(len(chars)) - np.repeat(begin, sizes)
    hashes = mix(np.add.reduceat(letters(place, low[chars]), begin) + sizes.astype(U))
    counts = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    return hashes, counts


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about ``limit`` bytes: first row, end row, bytes, offsets in them.

    A row longer than that comes alone. Null rows are empty.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def row_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``hash_words`` over a column: first row, end row, word hashes, words per row. Long rows go in pieces."""
    for row, end, data, off in text_slices(column):
        if end == row + 1 and len(data) > 2 * SLICE_BYTES:
            parts, at = [], 0
            while at < len(data):
                to = min(len(data), at + SLICE_BYTES)
                while to < len(data):
                    gap = np.flatnonzero(_LUT[data[to : to + 4096]] == 32)
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(len(data), to + 4096)
                parts.append(hash_words(data[at:to], np.zeros(1, np.int64))[0])
                at = to
            words = np.concatenate(parts)
            yield row, end, words, np.array([len(words)])
        else:
            words, counts = hash_words(data, off[:-1])
            yield row, end, words, counts


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )
