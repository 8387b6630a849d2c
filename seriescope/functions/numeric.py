"""Column expressions used throughout: finite values, guarded division, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to spreads so that they never divide by zero.
EPS = 1e-12


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or(x: Column, other: float | None) -> Column:
    """``x`` where it is finite, else ``other`` (null: no value)."""
    return F.when(is_finite(x), x).otherwise(F.lit(other).cast("double"))


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b, and ``other`` where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(other))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """An array scaled to length 1; the length counts as 1e-12 at least."""
    # Named by a lambda, as a length that stands inside one would be computed anew for each element.
    length = F.array(F.greatest(norm(a), F.lit(EPS)))
    return F.get(F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))
