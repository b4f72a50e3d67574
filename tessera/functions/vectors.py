"""Vector arithmetic as column expressions over arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def is_finite(a: Column) -> Column:
    """No null, NaN or infinite element."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.forall(a, fine)


def is_close(a: Column, b: Column) -> Column:
    """Equal up to nine significant digits."""
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b))
