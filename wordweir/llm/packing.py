"""Packing by powers of two: no sequence crosses documents, and none is padded.

A document's token ids (with the end-of-document id) are cut into as many pieces of the full length as fit, then into
the binary parts of the rest, largest first. Every piece is a sequence of its own; its bucket is the logarithm
of its length. ``write_buckets`` brings equal lengths together, one folder for each bucket without a shuffle, and ``bucket_batches`` draws
batches from one bucket at a time, so all rows of a batch have equal length.

Tokens come from a ``tokenizers`` file (byte-level BPE). Such a tokenizer works on the pieces that its pre-tokenizing
pattern cuts; ids of recent pieces are held in each worker. Texts in which the tokenizer may see something else
(its special tokens, or characters that later Unicode versions class differently) go to it as a whole.

Defined cases: a null or empty text is only the end id; repeated rows are packed each; sequence ids are unique,
and follow the partitions' order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches, held, released

SEQUENCE, END_ID = 2048, 1
#: The pieces that byte-level pre-tokenizers cut (fixed value), as the standard library's expressions say it: the same
#: for the characters of PLAIN, for which alone it is used.
PATTERN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters whose classes are the same in all Unicode versions and in both libraries' expressions: Latin (but the
#: superscript digits and fractions), Greek, Cyrillic, general punctuation, the common ideographs and Hangul.
PLAIN = re.compile("[\x00-\x1b\x20-±´-¸º»¿-ԧ‐-‧‰-⁞一-龥가-힣]*")
#: Pieces held are at most twice so many: those met since the last turn, and those of the turn before.
HELD_PIECES, HELD_CHARS = 300_000, 48
#: Longer texts are cut, at places where a piece ends anyway, so that not all their pieces are in memory.
PART_CHARS, CUT = 1 << 20, re.compile(r"\S (?=[^\W\d_])")


def byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself if it is visible Latin-1, else the next above 255."""
    seen = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def lengths(n: int, full: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in their order."""
    out = [full] * (n // full)
    rest = n % full
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Ids(dict):
    """Ids, as little-endian 32-bit numbers, of texts; those of short pieces are held, up to a bound."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.before = self.tokenizer.model, byte_letters(), {}
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(piece) <= HELD_CHARS:
            if len(self) >= HELD_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or self.special.search(text):
            return self.whole(text)
        if len(text) <= PART_CHARS:
            return b"".join(map(self.__getitem__, PATTERN.findall(text)))
        parts, at = [], 0
        while at < len(text):
            # no piece goes over a space that stands between other characters and a letter
            to = CUT.search(text, at + PART_CHARS)
            end = to.start() + 1 if to else len(text)
            parts.append(b"".join(map(self.__getitem__, PATTERN.findall(text, at, end))))
            at = end
        return b"".join(parts)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", full: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, start, length, ids (packed little-endian 32-bit), doc_tokens, bucket, sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor; ``full`` is a power of two.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("the full length must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held("ids", tokenizer, lambda: Ids(tokenizer))

        def rows(part: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                doc, data = doc.as_py(), ids.of(text.as_py()) + end
                n, start = len(data) // 4, 0
                for length in lengths(n, full):
                    yield doc, start, length, data[4 * start : 4 * (start + length)], n, length.bit_length() - 1
                    start += length

        for part in parts:
            out = pa.schema(
                [
                    ("id", part.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("bucket", pa.int32()),
                ]
            )
            yield from batches(rows(part), out)

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        released(run, holds=True), f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int"
    )
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "bucket",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each bucket; within it, files by input partition."""
    pieces.write.partitionBy("bucket").parquet(path)


def bucket_batches(spark: SparkSession, path: str, rows: int) -> Iterator[list[Row]]:
    """Batches of at most ``rows`` sequences of one length, bucket by bucket; one partition at a time is in memory."""
    for bucket in sorted(r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect()):
        batch = []
        for row in spark.read.parquet(path).where(F.col("bucket") == bucket).toLocalIterator():
            batch.append(row)
            if len(batch) == rows:
                yield batch
                batch = []
        if batch:
            yield batch
