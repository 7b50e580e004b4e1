"""Vector columns (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import let


def as_double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where either vector has no direction."""
    a, b = as_double(a), as_double(b)
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def normalise(v: Column) -> Column:
    """Unit length; NULL for a zero vector, which no search may return."""
    return let(
        as_double(v),
        lambda d: let(norm(d), lambda length: F.when(length > 0, F.transform(d, lambda x: x / length))),
    )


def fit_dimensions(v: Column, n: int) -> Column:
    """Cut to n numbers or pad with zeros up to n."""
    return F.slice(
        F.concat(as_double(v), F.array_repeat(F.lit(0.0), n)), 1, n
    )
