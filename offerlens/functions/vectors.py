"""Vector Column helpers on ``array<float|double>`` columns (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["dot", "l2_norm", "normalize", "cosine"]

NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    """Sum of element products in double precision, left to right."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector with the norm floored at 1e-12 (a zero vector stays zero)."""
    n = F.greatest(l2_norm(a), F.lit(NORM_FLOOR))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, each renormalised defensively."""
    na = F.greatest(l2_norm(a), F.lit(NORM_FLOOR))
    nb = F.greatest(l2_norm(b), F.lit(NORM_FLOOR))
    return dot(a, b) / (na * nb)
