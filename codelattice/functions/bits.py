"""Sparse binary codes as columns.

Logically a code is the sorted array of its active positions; for comparisons it is packed into
64-bit words, so that overlaps are ``bit_count(a & b)`` per word and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def active(values: Column, is_set=lambda v: v != 0) -> Column:
    """Active positions of an array of values; null values are not set."""
    places = F.transform(values, lambda v, i: F.when(is_set(v), i))
    return F.array_compact(places)


def parse01(text: Column) -> Column:
    """Active positions of a string of 0 and 1."""
    return active(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c == "1")


def to01(bits: Column, length: int) -> Column:
    """The code as a string of 0 and 1."""
    return F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(F.array_contains(bits, i), "1").otherwise("0")), ""
    )


def filled(length: int, value: bool) -> Column:
    """All or none of the positions of a new code."""
    return F.sequence(F.lit(0), F.lit(length - 1)) if value else F.array().cast("array<int>")


def with_bit(bits: Column, place: Column, value: bool = True) -> Column:
    """The code with one position set or cleared."""
    one = F.array(place.cast("int"))
    return F.array_sort(F.array_union(bits, one)) if value else F.array_except(bits, one)


def pack(bits: Column, length: int) -> Column:
    """The code as ceil(length / 64) long words, lowest positions first."""
    words = F.sequence(F.lit(0), F.lit((length + 63) // 64 - 1))

    def word(w):
        own = F.filter(bits, lambda b: F.floor(b / 64) == w)
        # positions are distinct, so the sum of powers is their union; 2^63 wraps to the sign bit
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, b: total.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))

    return F.transform(words, word)


def popcount(words: Column) -> Column:
    """Number of active positions of a packed code."""
    return F.aggregate(words, F.lit(0), lambda total, w: total + F.bit_count(w))


def common(a: Column, b: Column) -> Column:
    """Number of positions active in both packed codes; codes of different lengths are an error."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda t, n: t + n)
    return F.when(F.size(a) == F.size(b), both).otherwise(F.raise_error(F.lit("codes differ in length")).cast("int"))


def union(a: Column, b: Column) -> Column:
    """Positions active in either code."""
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    """Positions active in both codes."""
    return F.array_sort(F.array_intersect(a, b))
