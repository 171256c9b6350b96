"""Vectors as arrays: validity and cosine similarity, native or by blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(a: Column, size: Column | int | None = None) -> Column:
    """Finite, not all zero and, where asked for, of that size; never null."""
    ok = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & (F.size(a) > 0) & (norm(a) > 0)
    if size is not None:
        ok = ok & (F.size(a) == size)
    return F.coalesce(ok, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of norm 0 or vectors of different sizes."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))
