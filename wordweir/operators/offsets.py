"""Where each text of a table begins in the table's virtual file.

The virtual file is the texts in the order of their key, each followed by one newline. The order is total: nulls come first, rows of
equal keys go by the hash of their text, and equal rows, which are alike, stand beside each other.

Offsets are a prefix sum over all rows, done in two passes: rows fall into key ranges of about ``RANGE_ROWS`` rows, cut at keys of
a bounded sample; the ranges' totals are summed (a few rows), and within each range a window sums (key, size) pairs, never the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RANGE_ROWS = 4_000_000
#: Keys sampled for each range.
SAMPLED = 20
#: Up to so many rows (of two numbers each) the offsets are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: What the hash of a text is called, by which rows of equal keys are told apart.
HASH = "__hash"
#: Bytes of a stretch, and so many stretches at most (beyond them stretches grow): tables that are read in order are dealt out by them.
STRETCH_BYTES, STRETCHES = 8 << 20, 4096
#: The bytes that part words.
DELIMITERS = b" \t\n\r"


class Places(NamedTuple):
    """A table and the columns that tell its rows apart: the key and, where that repeats, the text's hash."""

    docs: DataFrame
    by: list[str]
    rows: int
    repeats: bool


def places(docs: DataFrame, key: Sequence[str], text: str) -> Places:
    """Reads the key columns only, to count rows and to see whether keys repeat."""
    found = docs.groupBy(*key).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if found[1] <= 1:
        return Places(docs, list(key), found[0], False)
    return Places(docs.withColumn(HASH, F.xxhash64(F.coalesce(text, F.lit("")))), [*key, HASH], found[0], True)


def same(by: Sequence[str], prefix: str) -> Column:
    """Equal columns, nulls included, on either side of a join; ``prefix`` is before the right side's."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in by])


def base_offsets(at: Places, text: str, prefix: str = "b_") -> DataFrame:
    """(columns of ``at.by`` with the prefix, base, size, copies): base is that of the first of the equal rows. A null text is an empty one."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    sizes = at.docs.select(F.struct(*at.by).alias("place"), size.alias("size"))
    sizes = sizes.groupBy("place", "size").agg(F.count("*").alias("copies")) if at.repeats else sizes.withColumn("copies", F.lit(1).cast("bigint"))
    ranges = max(1, -(-at.rows // RANGE_ROWS))
    out = [*(F.col(f"place.{c}").alias(prefix + c) for c in at.by), "base", "size", "copies"]
    within = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0))
    if ranges == 1:
        return sizes.withColumn("range", F.lit(0)).withColumn("base", local).select(*out)
    # at most twice the rows that are expected come to the driver; any cuts give right offsets
    some = sizes.where(F.pmod(F.xxhash64("place"), F.lit(at.rows)) < SAMPLED * ranges).select("place").orderBy("place").limit(2 * SAMPLED * ranges).collect()
    kinds = sizes.schema["place"].dataType
    cuts = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["place"], kinds, strict=True))) for r in some[SAMPLED - 1 :: SAMPLED]]
    sizes = sizes.withColumn("range", F.size(F.filter(F.array(*cuts), lambda c: c < F.col("place"))) if cuts else F.lit(0))
    totals = sizes.groupBy("range").agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    return sizes.withColumn("local", local).join(F.broadcast(starts), "range").withColumn("base", F.col("start") + F.col("local")).select(*out)


def with_base(docs: DataFrame, key: Sequence[str], text: str, extra: Sequence[str] = ()) -> DataFrame:
    """(``extra`` columns, text, base), a row for each row."""
    at = places(docs, key, text)
    base = base_offsets(at, text)
    base = F.broadcast(base) if at.rows <= BROADCAST_ROWS else base
    rows = at.docs.select(*at.by, F.struct(*extra).alias("extra") if extra else F.lit(0).alias("extra"), F.col(text).alias("text"))
    rows = rows.join(base, same(at.by, "b_"))
    more = [F.col(f"extra.{c}").alias(c) for c in extra]
    if not at.repeats:
        return rows.select(*more, "text", "base")
    # equal rows: numbered within their key and hash; only their texts are shuffled
    one = rows.where("copies = 1").select(*more, "text", "base")
    number = F.row_number().over(Window.partitionBy(*at.by).orderBy(F.lit(0))) - 1
    many = rows.where("copies > 1").withColumn("base", F.col("base") + number * F.col("size"))
    return one.unionByName(many.select(*more, "text", "base"))


class Order(NamedTuple):
    """A table cut into stretches of ``step`` bytes of its virtual file; for each, the place of the text that holds its first byte, and where what the
    stretch has of that text begins. Of each text (or run of equal rows) that holds several first bytes, ``long`` has by the first of these
    stretches where it begins, and how often the text is there.
    """

    at: Places
    text: str
    step: int
    cuts: list[Row]
    bases: list[int]
    long: dict[int, tuple[int, int]]


def order(docs: DataFrame, key: Sequence[str], text: str, unit: int) -> Order:
    """Stretches are whole ``unit``s. Three numbers and a place for each stretch come to the driver."""
    at = places(docs, key, text)
    step = unit * -(-STRETCH_BYTES // unit)
    last = F.expr(f"(base + size * copies - 1) div {step}")
    begun = F.sequence(F.expr(f"(base + {step - 1}) div {step}"), last)
    found = base_offsets(at, text).where(F.expr(f"(base + {step - 1}) div {step}") <= last)
    found = found.select(F.explode(begun).alias("stretch"), F.struct(*(F.col(f"b_{c}").alias(c) for c in at.by)).alias("place"), "base", "copies")
    found = found.orderBy("stretch").collect()
    thin = -(-len(found) // STRETCHES) or 1
    found, step = found[::thin], step * thin
    bases, long = [r["base"] for r in found], {}
    for k, (one, other) in enumerate(pairwise(found)):
        if one["base"] == other["base"]:
            if not k or found[k - 1]["base"] != one["base"]:
                long[k] = one["base"], one["copies"]
                bases[k] = k * step
            bases[k + 1] = (k + 1) * step
    return Order(at, text, step, [r["place"] for r in found], bases, long)


def pieces(text: bytes, base: int, copies: int, first: int, last: int, step: int) -> Iterator[tuple[int, bytes]]:
    """What the stretches from ``first`` to ``last`` have of a text that begins at ``base`` and is there ``copies`` times, a newline between: the words that begin in them.

    A piece begins with the stretch or the text; the rest of a word that began before is blank. That of the last stretch goes on to the end.
    """
    line, size, delimiter = text + b"\n", len(text) + 1, re.compile(b"[" + DELIMITERS + b"]")
    total = size * copies - 1

    def whole(at: int) -> int:
        """The end of the word that goes over the boundary at ``at``, or ``at``."""
        if not 0 < at < total or line[(at - 1) % size] in DELIMITERS:
            return at
        return at - at % size + delimiter.search(line, at % size).start()  # a line ends with a delimiter

    for stretch in range(max(0, first), last + 1):
        begin, end = max(0, stretch * step - base), min(total, (stretch + 1) * step - base)
        start = whole(begin)
        if start < end or stretch == last:
            end, skip = max(start, whole(end)), start - start % size
            lines = line * -(-(end - skip) // size)
            yield stretch, b" " * (start - begin) + lines[start - skip : end - skip]


def in_order(table: Order, start: int = 0, end: int | None = None) -> DataFrame:
    """(stretch, text) of the stretches that have bytes of [start, end): each in one task, its texts in order. It is the texts' only shuffle.

    A stretch has all texts of which it has a byte: one that goes over a boundary is in the stretches on both sides. Those that go over
    several are dealt out in pieces, so that what is shuffled grows as the table, whatever the texts' sizes.
    """
    at, kind = table.at, StructType([table.at.docs.schema[c] for c in table.at.by])
    cuts = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind, strict=True))) for r in table.cuts))
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(len(table.cuts).bit_length()))))
    place = F.col("place")

    def cuts_before(less: Callable[[Column], Column]) -> Column:
        """How many cuts ``less`` holds for, by halving; beyond the last cut ``get`` is null."""
        return F.aggregate(halves, F.lit(0), lambda n, half: F.when(less(F.get(cuts, n + half - 1)), n + half).otherwise(n))

    low, high = start // table.step, len(table.cuts) if end is None else min(len(table.cuts), -(-end // table.step))
    rows = at.docs.select(F.struct(*at.by).alias("place"), F.col(table.text).alias("text"))
    if low >= high:
        return rows.select(F.lit(0).alias("stretch"), "text").where("false")
    rows = rows.select("place", "text", (cuts_before(lambda c: c < place) - 1).alias("first"), (cuts_before(lambda c: c <= place) - 1).alias("last"))
    short = rows.where("last - first < 2") if table.long else rows
    dealt = short.select(F.explode(F.sequence("first", "last")).alias("stretch"), "place", "text")
    if table.long:
        cut = _cut(table, rows.where("last - first > 1"))
        dealt = dealt.unionByName(cut.select("stretch", F.get(cuts, F.col("cut")).alias("place"), "text"))
    dealt = dealt.where(F.col("stretch").between(low, high - 1))
    return dealt.repartition(high - low, "stretch").sortWithinPartitions("stretch", "place").select("stretch", "text")


def _cut(table: Order, rows: DataFrame) -> DataFrame:
    """(stretch, cut, text): the pieces of the long texts (place, text, first, last), equal rows as one; cut: the first stretch whose first byte the text has."""
    long, step = table.long, table.step
    if any(copies > 1 for _, copies in long.values()):
        rows = rows.groupBy("place", "first", "last").agg(F.first("text").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, last, text in zip(*(part.column(c) for c in ("first", "last", "text")), strict=True):
                first, data = first.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b""
                for stretch, piece in pieces(data, *long[first + 1], first, last.as_py(), step):
                    place = [pa.array([k], pa.int32()) for k in (stretch, first + 1)]
                    yield pa.RecordBatch.from_arrays([*place, pa.array([piece], pa.binary()).cast(text.type)], names=["stretch", "cut", "text"])

    return rows.select("first", "last", "text").mapInArrow(run, f"stretch int, cut int, text {rows.schema['text'].dataType.simpleString()}")
