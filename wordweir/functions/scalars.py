"""Sizes with units, order-preserving word prefixes, record sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units are powers of 1024; the letter b may follow either the number or the unit (fixed values).
SIZE_PATTERN = r"(\d+)([kKmMgGtT])?[bB]?"
SHIFTS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}


class SizeError(ValueError):
    """Not a size."""


def parse_size(text: str) -> int:
    """Bytes of '4096', '64k', '1g', '2GB' ..."""
    found = re.fullmatch(SIZE_PATTERN, text, re.ASCII)
    if not found:
        raise SizeError(f"not a size: {text!r}")
    return int(found[1]) << SHIFTS[(found[2] or "").lower()]


def size_bytes(text: Column) -> Column:
    """``parse_size`` as an expression; null where the text is not a size, or one of 2 ** 63 bytes or more."""
    number, unit = (F.regexp_extract(text, f"\\A{SIZE_PATTERN}\\z", k) for k in (1, 2))
    shift = F.lit(0)
    for letter, bits in SHIFTS.items():
        if letter:
            shift = F.when(F.lower(unit) == letter, bits).otherwise(shift)
    # decimals of 38 digits hold what a long shifted by 40 bits is; a longer number is no size
    number = F.when(F.length(number) > 0, number.try_cast("decimal(38,0)"))
    units = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    fits = number <= F.floor(F.lit((1 << 63) - 1).cast("decimal(20,0)") / units)
    return F.when(fits, number.cast("decimal(20,0)").try_cast("bigint") * units)


def prefix_key(word: Column) -> Column:
    """First eight bytes, padded by zero bytes, as hexadecimal text: it orders as the bytes do."""
    return F.rpad(F.left(F.hex(word.cast("binary")), F.lit(16)), 16, "0")


def prefix_tail(word: Column) -> Column:
    """What follows the first eight bytes, as hexadecimal text (empty if nothing does)."""
    code = F.hex(word.cast("binary"))
    return F.substring(code, F.lit(17), F.length(code))


def prefix_word(prefix: Column, tail: Column) -> Column:
    """The word of a prefix key and a tail; of words of less than eight bytes the padding is taken off (they end in no zero byte)."""
    bare = F.when(F.length(tail) > 0, prefix).otherwise(F.regexp_replace(prefix, "(00)+$", ""))
    return F.unhex(F.concat(bare, tail)).cast("string")


def prefix_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1: the order of two words by their prefix keys first and their tails where these are equal."""
    a, b = prefix_key(left), prefix_key(right)
    c, d = prefix_tail(left), prefix_tail(right)
    return F.when(a < b, -1).when(a > b, 1).when(c < d, -1).when(c > d, 1).otherwise(0)


def record_size(word: Column, repeated: Column) -> Column:
    """Bytes of a compact profile record: the word, its end mark, the flag, and the offset if there is one."""
    return (F.octet_length(word) + 2 + F.when(repeated, 0).otherwise(8)).cast("bigint")
