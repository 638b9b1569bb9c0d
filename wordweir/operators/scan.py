"""The word scan: maximal runs of bytes other than space, tab, line feed and carriage return.

Offsets within a text are running sums over its tokens, which no built-in function forms without exploding, shuffling and
sorting all words; so the scan is one Arrow pass, vectorised over the bytes of a batch, with no work per word in
Python. For profiles the pass also combines equal words of a batch, so that fewer rows come back to the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .offsets import DELIMITERS, Order, Places, in_order, with_base

#: Bytes of text that are vectorised at once.
SLICE = 1 << 20
#: Slices whose counts are combined before they go to the JVM.
TOGETHER = 4

_GAP = np.zeros(256, bool)
_GAP[list(DELIMITERS)] = True


def find_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; no word goes over one of the ``edges`` (first bytes of texts)."""
    part = np.zeros(len(data) + 1, bool)
    part[:-1] = ~_GAP[data]
    first = part.copy()
    first[1:] &= ~part[:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = part[inner]
    starts = np.flatnonzero(first)
    last = np.zeros(len(data) + 1, bool)
    last[1:] = part[:-1] & (~part[1:] | first[1:])
    return starts, np.flatnonzero(last)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: first row, end row, bytes, offsets of the rows in them. Nulls are empty."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The words as an Arrow array: their bytes moved together, without a loop over words."""
    kept = np.zeros(len(data) + 1, np.int8)
    kept[starts] += 1
    kept[ends] -= 1
    body = data[np.cumsum(kept[:-1], dtype=np.int8) > 0]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def scan_batch(texts: pa.Array, bases: np.ndarray, kind: pa.DataType) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Row number, word and offset of each word."""
    for row, end, data, offsets in slices(texts):
        starts, ends = find_words(data, offsets[:-1])
        owner = np.searchsorted(offsets, starts, "right") - 1
        yield owner + row, word_array(data, starts, ends, kind), bases[row:end][owner] + starts - offsets[owner]


def let_go() -> None:
    """Memory that a batch took and a worker, which lives on, would keep."""
    pa.default_memory_pool().release_unused()


def combined(slices: Iterator[pa.Table], by: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of the columns ``by`` and at: how often (n) and where first (at), a row for each value of ``by`` in ``TOGETHER`` slices."""
    names, held = [*by, "n", "at"], []

    def together() -> pa.Table:
        if len(held) == 1:
            return held[0]
        return pa.concat_tables(held).group_by(by, use_threads=False).aggregate([("n", "sum"), ("at", "min")]).rename_columns(names)

    for words in slices:
        held.append(words.group_by(by, use_threads=False).aggregate([("at", "count"), ("at", "min")]).rename_columns(names))
        if len(held) == TOGETHER:
            yield together()
            held.clear()
    if held:
        yield together()


def _kinds(docs: DataFrame, extra: Sequence[str]) -> str:
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)


def words(docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """(word, off) and the ``extra`` columns, one row per occurrence."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bases = part.column("base").to_numpy(zero_copy_only=False)
            for owner, word, off in scan_batch(part.column("text"), bases, pa.string()):
                more = [part.column(c).take(pa.array(owner)) for c in extra]
                yield pa.RecordBatch.from_arrays([word, pa.array(off), *more], names=["word", "off", *extra])

    rows = with_base(docs, key, text, extra).select("text", "base", *extra)
    return rows.mapInArrow(run, f"word string, off bigint{_kinds(docs, extra)}")


def partial_counts(
    docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", extra: Sequence[str] = (), segment_bytes: int | None = None,
    start: int = 0, end: int | None = None,
) -> DataFrame:
    """(word, n, first_off), the ``extra`` columns and, if asked for, segment_id: combined within each batch.

    Only words that begin in [start, end) of the virtual file; texts that lie outside do not reach the scan.
    """
    by = ["word", *extra, *(["segment_id"] if segment_bytes else [])]

    def tables(part: pa.RecordBatch) -> Iterator[pa.Table]:
        bases = part.column("base").to_numpy(zero_copy_only=False)
        for owner, word, off in scan_batch(part.column("text"), bases, pa.string()):
            if start or end is not None:
                inside = (off >= start) & (off < (off.max(initial=0) + 1 if end is None else end))
                owner, word, off = owner[inside], word.filter(pa.array(inside)), off[inside]
            columns = {"word": word, "at": pa.array(off), **{c: part.column(c).take(pa.array(owner)) for c in extra}}
            if segment_bytes:
                columns["segment_id"] = pa.array(off // segment_bytes)
            yield pa.table(columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for found in combined(tables(part), by):
                yield from found.rename_columns([*by, "n", "first_off"]).combine_chunks().to_batches()
            del part
            let_go()

    rows = with_base(docs, key, text, extra).select("text", "base", *extra)
    if start:
        rows = rows.where(F.col("base") + F.coalesce(F.octet_length("text"), F.lit(0)) > start)
    if end is not None:
        rows = rows.where(F.col("base") < end)
    segment = ", segment_id bigint" if segment_bytes else ""
    return rows.mapInArrow(run, f"word string{_kinds(docs, extra)}{segment}, n bigint, first_off bigint")


def segment_counts(table: Order, segment_bytes: int, start: int = 0, end: int | None = None) -> DataFrame:
    """(word, segment_id, n, first_off), one row for each word of each segment: what begins in [start, end) of the virtual file.

    The stretches of ``table`` are whole segments, so each segment's words meet in one task and are not shuffled. A task holds a
    slice of text and the counts of the segment it has not finished.
    """
    by, names = ["segment_id", "word"], ["segment_id", "word", "n", "first_off"]
    step, bases = table.step, table.bases

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stretch, base = None, -1, 0
        for part in parts:
            of = part.column("stretch").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in pairwise(edges):
                if a == b:
                    continue
                if of[a] != stretch:
                    if held is not None:
                        yield from held.to_batches()
                    held, stretch = None, int(of[a])
                    base = bases[stretch]
                low, high = max(start, stretch * step), (stretch + 1) * step if end is None else min(end, (stretch + 1) * step)
                texts = part.column("text").slice(a, b - a)
                sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                ends = base + np.cumsum(sizes)
                base = int(ends[-1])
                for _, word, off in scan_batch(texts, ends - sizes, pa.string()):
                    # offsets only grow
                    i, j = np.searchsorted(off, (low, high))
                    off = off[i:j]
                    found = pa.table({"segment_id": off // segment_bytes, "word": word.slice(i, j - i), "off": off})
                    found = found.group_by(by, use_threads=False).aggregate([("off", "count"), ("off", "min")]).rename_columns(names)
                    if not found.num_rows:
                        continue
                    if held is not None:
                        more = pc.equal(found.column("segment_id"), held.column("segment_id")[0])
                        both = pa.concat_tables([held, found.filter(more)]).group_by(by, use_threads=False).aggregate([("n", "sum"), ("first_off", "min")])
                        found = pa.concat_tables([both.rename_columns(names), found.filter(pc.invert(more))])
                    last = pc.equal(found.column("segment_id"), int(off[-1]) // segment_bytes)
                    held = found.filter(last).combine_chunks()
                    yield from found.filter(pc.invert(last)).combine_chunks().to_batches()
            del part, texts
            let_go()
        if held is not None:
            yield from held.to_batches()

    return in_order(table, start, end).mapInArrow(run, "segment_id bigint, word string, n bigint, first_off bigint")


def partial_places(at: Places, text: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """(word, n, first) and the ``extra`` columns, combined within each batch; first: (columns of ``at.by``, local offset).

    Places order as offsets in the virtual file do, and need no offsets of texts.
    """
    by = ["word", *extra]
    place = [f"key_{c}" for c in at.by]
    rows = at.docs.select(*(F.col(c).alias(f"key_{c}") for c in at.by), F.col(text).alias("text"), *extra)
    kinds = ", ".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in place)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = pa.table({c: part.column(c) for c in place})
            order = pc.sort_indices(keys, [(c, "ascending") for c in place], null_placement="at_start").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))

            def tables(part: pa.RecordBatch = part, rank: np.ndarray = rank) -> Iterator[pa.Table]:
                for owner, word, off in scan_batch(part.column("text"), np.zeros(part.num_rows, np.int64), pa.string()):
                    yield pa.table({"word": word, "at": pa.array((rank[owner] << 32) + off), **{c: part.column(c).take(pa.array(owner)) for c in extra}})

            for found in combined(tables(), by):
                at = found.column("at").to_numpy()
                taken = pa.array(order[at >> 32].astype(np.int64))
                fields = [part.column(c).take(taken) for c in place] + [pa.array(at & 0xFFFFFFFF)]
                first = pa.StructArray.from_arrays(fields, names=[*place, "local"])
                arrays = [*(found.column(c).combine_chunks() for c in by), found.column("n").combine_chunks(), first]
                yield pa.RecordBatch.from_arrays(arrays, names=[*by, "n", "first"])
            del part, keys, tables
            let_go()

    return rows.mapInArrow(run, f"word string{_kinds(at.docs, extra)}, n bigint, first struct<{kinds},local:bigint>")


def words_by_window(docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The same rows as ``words`` from built-in functions only; it shuffles and sorts every word. For comparison."""
    rows = with_base(docs, key, text)
    split = F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]", -1)
    tokens = rows.select("base", F.posexplode(split).alias("pos", "word"))
    # no two texts begin at the same place
    before = Window.partitionBy("base").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("base") + F.coalesce(F.sum(F.octet_length("word") + 1).over(before), F.lit(0))
    return tokens.select("word", off.alias("off")).where("word <> ''")
