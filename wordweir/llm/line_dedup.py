"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over a threshold.

A line's key is the line without white space at both ends and with A-Z lower-cased. Only keys of at least
``MIN_CHARS`` code points are hashed (128 bits); a key found in at least ``MIN_DOCS`` documents loses its lines everywhere
but in the largest document id that holds it. What a document loses comes back to it as a list of places, and its
other lines are put together again by position.

A very common key is no hot spot: its documents are counted map-side, and the join that brings its verdict back has
an exchange on either side, which Spark can split where it is skewed.

Defined cases: a null or empty text is one empty line; rows that repeat a document id count as one document; rows without an id lose nothing and are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, a_z, cut, once

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is the fast way, and the same where all is ASCII
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, A_Z, a_z))


def line_hash(line: Column) -> Column:
    """128 bits of the key; null if the key is short."""
    long = F.length(F.btrim(line, F.lit(BLANKS))) >= MIN_CHARS
    key = line_key(line)
    return F.when(long, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(77), key).alias("b")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]


def lost_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, lost): the places of the lines that a document loses."""
    hashes = F.transform(lines_of(F.col(text_col)), line_hash)
    held = docs.where(F.col(id_col).isNotNull()).select(*row_key(id_col, text_col), F.posexplode(hashes).alias("at", "h"))
    held = cut(held.where("h is not null").select("id", "text_hash", "at", "h.a", "h.b"))
    counted = held.groupBy("a", "b", "id").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("owner"))
    common = cut(counted.where(F.col("n") >= min_docs).select("a", "b", "owner"))
    lost = held.join(common, ["a", "b"]).where(F.col("id") != F.col("owner"))
    return lost.groupBy("id", "text_hash").agg(F.collect_set("at").alias("lost"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Columns of ``docs`` as the struct ``record``, with n_lines, n_dropped and the text that is left, ``kept``."""
    lost = lost_lines(docs, id_col, text_col, min_docs)
    joined = docs.select(*row_key(id_col, text_col), F.struct("*").alias("record")).join(lost, ["id", "text_hash"], "left")
    text = F.coalesce(F.col("record")[text_col], F.lit(""))

    def put_together(lines: Column) -> Column:
        # by sets of places: linear in the number of lines
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    n_lines = F.size(lines_of(text)).cast("bigint")
    n_dropped = F.coalesce(F.size("lost"), F.lit(0)).cast("bigint")
    kept = F.when(F.col("lost").isNull(), text).otherwise(once(lines_of(text), put_together))
    return joined.select("record", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("kept"))
