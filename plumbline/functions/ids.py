"""One 64-bit id for a pair of numbers, as `major * base + minor` while that is unique."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids from here on hold pairs whose minor number doesn't fit under the base.
HIGH = 1 << 62
#: Bits of the two numbers, each signed, in such an id.
MAJOR_BITS, MINOR_BITS = 34, 28
#: Passages a document and turns a conversation that plain ids have room for.
PASSAGES, TURNS = 10_000, 1000


def pack(major: Column, minor: Column, base: int) -> Column:
    """An id of its own for each pair; null where either is null. Pairs out of both ranges are an error."""
    major, minor = major.cast("long"), minor.cast("long")
    most, half = HIGH // base - 1, 1 << (MINOR_BITS - 1)
    plain = (minor >= 0) & (minor < base) & major.between(-most, most)
    wide = major.between(-(1 << (MAJOR_BITS - 1)), (1 << (MAJOR_BITS - 1)) - 1) & minor.between(-half, half - 1)
    high = F.lit(HIGH) + (major + F.lit(1 << (MAJOR_BITS - 1))) * F.lit(1 << MINOR_BITS) + (minor + half)
    error = F.raise_error(F.format_string("no id for the pair %d, %d", major, minor)).cast("long")
    return F.when(major.isNull() | minor.isNull(), F.lit(None).cast("long")).when(plain, major * base + minor).when(wide, high).otherwise(error)


def major_of(packed: Column, base: int) -> Column:
    """The first number of the pair."""
    high = F.shiftright(packed - F.lit(HIGH), MINOR_BITS) - F.lit(1 << (MAJOR_BITS - 1))
    return F.when(packed >= HIGH, high).otherwise(F.call_function("div", packed - F.pmod(packed, F.lit(base)), F.lit(base)))
