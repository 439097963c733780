"""Column expressions on strings: end-last order, common prefixes, packing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorts after every other code point, so that the end of a string sorts last.
END = "\U0010ffff"


def end_last(text: Column) -> Column:
    """Sort key in which a string sorts after all its extensions."""
    return F.concat(text, F.lit(END))


def prefix(text: Column, length) -> Column:
    return F.substring(text, 1, length)


def rest(text: Column, start: Column) -> Column:
    """The string from the 0-based `start` on."""
    return text.substr(start + F.lit(1), F.length(text))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings that are not null."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when(a == b, F.length(a)).when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.array_position(differs, True) - 1).cast("long")


def bits_per_symbol(alphabet: int) -> int:
    return math.floor(math.log2(alphabet + 1) + 0.5 + 0.5)


def packed_segment(text: Column, alphabet: int = 128) -> Column:
    """The next `32 / bits` symbols as one unsigned number, left aligned; the first place after the end is all ones."""
    bits = bits_per_symbol(alphabet)
    items = 32 // bits
    value = F.lit(0).cast("long")
    for i in range(items):
        symbol = F.when(F.length(text) > i, F.ascii(text.substr(i + 1, 1))).when(F.length(text) == i, (1 << bits) - 1).otherwise(0)
        value = F.shiftleft(value, bits) + symbol
    return F.shiftleft(value, 32 % bits).cast("long")
