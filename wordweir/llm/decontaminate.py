"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Every item gives its windows of ``window`` consecutive words (an item with fewer words, but not none, is
one window). All windows become patterns of one automaton over word numbers (``automaton``), which scans each normalised
text once; the matches are mapped back to word numbers and to character offsets in the original text.

Defined cases: a null or empty text has no words and no hits; items without an id or without words are
ignored; rows of the same ``item_id`` count as one item; repeated documents each get their own result;
an empty benchmark hits nothing; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import WORD_BYTES, held, released, to_batch

WINDOW = 8
#: Bytes of item texts in one automaton, which takes 22 times as many, and 40 times while it is built (measured on random words: each
#: stands in eight windows). A larger benchmark is scanned in as many passes as it has blocks.
BLOCK_BYTES = 12 << 20

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RANGE = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    if not ranges:
        return []
    raw = text.encode("utf-8", "replace")
    flat = raw.translate(WORD_BYTES)
    places, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at := at + len(w)))
    out, chars, done = [], 0, 0
    for first, last in ranges:
        a, b = places[first][0], places[last][1]
        start = chars + len(raw[done:a].decode())
        chars, done = start + len(raw[a:b].decode()), b
        out.append({"start": start, "end": chars})
    return out


def _send(docs: DataFrame, items: list[tuple[str, str]], size: int) -> tuple[Broadcast, str]:
    key = hashlib.sha256(repr((size, items)).encode("utf-8", "replace")).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(items), key


def _pass(docs: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    """docs: columns id, text_hash, text. One scan by one automaton."""
    sent, key = _send(docs, items, size)
    id_type = docs.schema["id"].dataType
    schema = (
        f"id {id_type.simpleString()}, text_hash bigint, n_words bigint, "
        "ranges array<struct<first:bigint,last:bigint>>, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held("automaton", key, lambda: Automaton(sent.value, size))
        for part in parts:
            out = pa.schema(
                [
                    ("id", part.schema.field("id").type), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                    ("ranges", pa.list_(_RANGE)), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)),
                ]
            )
            texts = part.column("text")
            rows = [
                (doc, text_hash, f.words, [{"first": a, "last": b} for a, b in f.ranges], f.items, spans(text.as_py(), f.ranges) if f.ranges else [])
                for doc, text_hash, text, f in zip(
                    part.column("id").to_pylist(), part.column("text_hash").to_pylist(), texts, automaton.scan(texts), strict=True
                )
            ]
            if rows:
                yield to_batch(rows, out)

    return docs.mapInArrow(released(run, holds=True), schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``limit`` bytes, one in memory at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r["item"], r["text"]) for r in block.collect())


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted), ranges of hit words, spans in the original text.

    The benchmark is broadcast in blocks of at most about ``block_bytes``; with more than one block the
    documents are scanned once for each, and the blocks' findings are merged per document.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    passes = [_pass(rows, items, window) for items in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    found = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            found = found.unionByName(p)
        # equal rows have equal findings: they are merged as one and dealt out again
        found = found.groupBy("id", "text_hash").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_set("ranges"))).alias("ranges"),
            F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
            (F.count("*") / len(passes)).cast("int").alias("copies"),
        )
        found = found.withColumn("ranges", _union("ranges", "first", "last", 1)).withColumn("spans", _union("spans", "start", "end", 0))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "ranges", "spans"
    )


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(5), text).alias("key_b")]


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, least: int = 1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents in which windows of fewer than ``least`` items occur; columns as before.

    One block is one narrow pass. Of more blocks, each is a scan of its own (no worker holds two automata), and the hashes
    of the texts that hold enough items are taken out by an anti-join.
    """
    blocks = list(_blocks(benchmark, item_col, item_text_col, block_bytes))
    if len(blocks) == 1:
        at, (sent, key) = docs.columns.index(text_col), _send(docs, blocks[0], window)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = held("automaton", key, lambda: Automaton(sent.value, window))
            for part in parts:
                yield part.filter(pa.array([len(f.items) < least for f in automaton.scan(part.column(at))], pa.bool_()))

        return docs.mapInArrow(released(run, holds=True), docs.schema)
    found = None
    for items in blocks:
        one = _counts(docs.select(*_text_key(F.col(text_col)), F.col(text_col).alias("text")), items, window)
        found = one if found is None else found.unionByName(one)
    # equal texts have equal counts in a block: the largest of a block is one text's
    per_block = found.groupBy("key_a", "key_b", "block").agg(F.max("n").alias("n"))
    gone = per_block.groupBy("key_a", "key_b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key_a", "key_b")
    whole = docs.select(*_text_key(F.col(text_col)), F.struct("*").alias("row"))
    return whole.join(gone, ["key_a", "key_b"], "left_anti").select("row.*")


def _counts(texts: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    """(key_a, key_b, block, n) of the texts in which n > 0 of the block's items occur."""
    sent, key = _send(texts, items, size)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held("automaton", key, lambda: Automaton(sent.value, size))
        for part in parts:
            n = pa.array([len(f.items) for f in automaton.scan(part.column("text"))], pa.int64())
            some = [i for i, k in enumerate(n.to_pylist()) if k]
            arrays = [part.column(c).take(pa.array(some, pa.int64())) for c in ("key_a", "key_b")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([key] * len(some), pa.string()), n.take(pa.array(some, pa.int64()))], names=["key_a", "key_b", "block", "n"])

    return texts.mapInArrow(released(run, holds=True), "key_a bigint, key_b bigint, block string, n bigint")


def _union(column: str, a: str, b: str, gap: int) -> Column:
    """Sorted intervals with those that meet made one."""
    kind = f"array<struct<{a}:bigint,{b}:bigint>>"
    return F.aggregate(column, F.array().cast(kind), lambda done, r: _add(done, r, a, b, gap, kind))


def _add(done: Column, r: Column, a: str, b: str, gap: int, kind: str) -> Column:
    last = F.try_element_at(done, F.lit(-1))
    head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    grown = F.struct(last[a].alias(a), F.greatest(last[b], r[b]).alias(b))
    return F.when(
        (F.size(done) > 0) & (r[a] <= last[b] + gap), F.concat(head, F.array(grown)).cast(kind)
    ).otherwise(F.concat(done, F.array(F.struct(r[a].alias(a), r[b].alias(b)))).cast(kind))
