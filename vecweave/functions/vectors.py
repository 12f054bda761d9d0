"""Vector columns (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared norms up to this are left as they are by normalised().
SMALL_NORM = 1e-9
#: Similarities are compared as integers of this many units, so that no sum depends on its order.
UNITS = 1_000_000


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in order; shorter vectors end both."""
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; vectors of nearly no length stay, so their similarities are zero."""
    square = F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(square <= SMALL_NORM, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / F.sqrt(square)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for empty vectors or ones of different length, 0 where one has no length."""
    odd = (F.size(a) != F.size(b)) | (F.size(a) <= 0)
    flat = (dot(a, a) == 0) | (dot(b, b) == 0)
    return F.when(a.isNull() | b.isNull() | odd, -1.0).when(flat, 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def units(similarity: Column) -> Column:
    return F.round(similarity * UNITS).cast("long")


def one_hot(indices: Column, dim: int) -> Column:
    """A dense 0/1 vector from a list of positions, written gap by gap; positions outside 0 .. dim - 1 are left out."""
    at = F.array_sort(F.array_distinct(F.filter(F.coalesce(indices, F.array().cast("array<int>")), lambda i: (i >= 0) & (i < dim))))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    # After each position the zeros up to the next one, or to the end.
    tail = F.transform(at, lambda x, i: F.concat(F.array(F.lit(1.0)), zeros(F.coalesce(F.get(at, i + 1), F.lit(dim)) - x - 1)))
    return F.concat(zeros(F.coalesce(F.get(at, F.lit(0)), F.lit(dim))), F.flatten(tail))
