"""Profiles: for every distinct word how often it occurs, where first, and, if only once, where.

A profile has the columns word, n, first_off, repeated, occur; ``occur`` is null if and only if the word is repeated. The
smaller form (word, repeated, occur) is enough to merge profiles and to ask for words that do not repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import record_size
from . import offsets
from .scan import partial_counts, partial_places, segment_counts

SMALL = ("word", "repeated", "occur")
#: A segment of up to so many bytes is counted by one task; the words of larger ones are shuffled.
TASK_BYTES = 64 << 20


def finish(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Final step of the two-phase aggregation of (by, word, n, first_off) rows."""
    totals = partials.groupBy(*by, "word").agg(F.sum("n").alias("n"), F.min("first_off").alias("first_off"))
    return _flagged(totals, by)


def _flagged(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    once = F.col("n") == 1
    return totals.select(*by, "word", "n", "first_off", (~once).alias("repeated"), F.when(once, F.col("first_off")).alias("occur"))


def profile(docs: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """The profile of a table; with ``by``, one profile for each value of these columns.

    Neither way shuffles a text. Where the texts' offsets are few enough they are broadcast to the scan; beyond
    that words are aggregated by place (key, local offset), and the offsets are joined to the distinct words.
    """
    at = offsets.places(docs, key, text)
    if at.rows <= offsets.BROADCAST_ROWS:
        return finish(partial_counts(docs, key, text, by), by)
    totals = partial_places(at, text, by).groupBy(*by, "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    totals = totals.select(*by, "word", "n", F.col("first.local").alias("local"), *(F.col(f"first.key_{c}").alias(f"at_{c}") for c in at.by))
    bases = offsets.base_offsets(at, text).select("base", *(F.col(f"b_{c}").alias(f"b_at_{c}") for c in at.by))
    # a repeated text's first copy is where the word first is
    placed = totals.join(bases, offsets.same([f"at_{c}" for c in at.by], "b_"))
    return _flagged(placed.select(*by, "word", "n", (F.col("base") + F.col("local")).alias("first_off")), by)


def profile_words(words: DataFrame) -> DataFrame:
    """The profile of (word, off) rows from any scan; words may be binary."""
    return finish(words.select("word", F.lit(1).cast("bigint").alias("n"), F.col("off").alias("first_off")))


def segment_profiles(
    docs: DataFrame, segment_bytes: int, key: Sequence[str] = ("doc_id",), text: str = "text", start: int = 0, end: int | None = None
) -> DataFrame:
    """One profile for each stretch of ``segment_bytes`` of the virtual file [start, end), with its segment_id.

    The cheap way to the profile of a whole table is ``profile``: this one shuffles the texts once, or those of segments beyond
    ``TASK_BYTES`` by segment and word.
    """
    if segment_bytes > TASK_BYTES:
        return finish(partial_counts(docs, key, text, segment_bytes=segment_bytes, start=start, end=end), ["segment_id"])
    return ordered_segments(offsets.order(docs, key, text, segment_bytes), segment_bytes, start, end)


def ordered_segments(table: offsets.Order, segment_bytes: int, start: int = 0, end: int | None = None) -> DataFrame:
    """``segment_profiles`` of a table whose order is known; it may be asked for several stretches."""
    return _flagged(segment_counts(table, segment_bytes, start, end), ["segment_id"])


def virtual_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of the virtual file."""
    return docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1), F.lit(0)).cast("bigint")).first()[0]


def segment_statistics(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_id").agg(
        F.count("*").alias("words"), F.sum(record_size(F.col("word"), F.col("repeated"))).alias("profile_bytes")
    )


def merge(*profiles: DataFrame) -> DataFrame:
    """Any number of profiles of disjoint inputs as one, in one shuffle.

    A word of several profiles is repeated. Commutative and associative; merging a profile with itself repeats
    every word. Counts and first offsets are kept if all have them.
    """
    full = all({"n", "first_off"} <= set(p.columns) for p in profiles)
    if full:
        return finish(reduce(DataFrame.unionByName, [p.select("word", "n", "first_off") for p in profiles]))
    rows = reduce(DataFrame.unionByName, [p.select(*SMALL) for p in profiles])
    merged = rows.groupBy("word").agg((F.bool_or("repeated") | (F.count("*") > 1)).alias("repeated"), F.min("occur").alias("occur"))
    return merged.select("word", "repeated", F.when(~F.col("repeated"), F.col("occur")).alias("occur"))


def merge_outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two profiles merged by a full outer join; the same rows as ``merge``."""
    a, b = (p.select("word", F.col("repeated").alias(f"{s}_repeated"), F.col("occur").alias(f"{s}_occur")) for p, s in ((left, "l"), (right, "r")))
    both = F.col("l_repeated").isNotNull() & F.col("r_repeated").isNotNull()
    repeated = both | F.coalesce("l_repeated", "r_repeated")
    return a.join(b, "word", "full_outer").select(
        "word", repeated.alias("repeated"), F.when(~repeated, F.coalesce("l_occur", "r_occur")).alias("occur")
    )


def singular(profile: DataFrame) -> DataFrame:
    """The words that do not repeat."""
    return profile.where(~F.col("repeated"))


def repeated(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("repeated"))


def first_words(profile: DataFrame, n: int = 1) -> DataFrame:
    """The first n words that do not repeat, in the order of their occurrence; no row if there is none."""
    return singular(profile).select("word", "occur").orderBy("occur").limit(n)


def in_order(profile: DataFrame) -> DataFrame:
    """All words that do not repeat, in the order of their occurrence."""
    return singular(profile).select("word", "occur").orderBy("occur")


def first_word_by(profiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first word that does not repeat within each value of ``by``: a grouped minimum, no sort."""
    low = F.min_by("word", "occur").alias("word")
    return singular(profiles).groupBy(*by).agg(low, F.min("occur").alias("occur"))


def ranked_words_by(profiles: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The first n of each value of ``by``, with their rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("occur"))
    return singular(profiles).withColumn("rank", place).where(F.col("rank") <= n).select(*by, "rank", "word", "occur")


def profile_bytes(profile: DataFrame) -> DataFrame:
    """Size of the profile in compact records."""
    return profile.agg(F.coalesce(F.sum(record_size(F.col("word"), F.col("repeated"))), F.lit(0)).cast("bigint").alias("bytes"))
