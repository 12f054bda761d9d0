"""Sorted vertex sets as arrays of longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(clique: Column) -> Column:
    return F.array_join(clique.cast("array<string>"), ",")


def signature(clique: Column) -> Column:
    """64 bits of which a subset's are a subset: a cheap test before comparing members."""
    return F.aggregate(clique, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(v), F.lit(64)).cast("int"))))


def within(a: Column, b: Column) -> Column:
    """All members of a are in b."""
    return F.size(F.array_except(a, b)) == 0


def pairs_of(k: Column) -> Column:
    return (k * (k - 1) / 2).cast("long")


def size_bin(k: Column) -> Column:
    return F.when(k <= 1, "1").when(k == 2, "2").when(k == 3, "3").when(k <= 5, "4-5").otherwise("6+")
