"""Vector algebra on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NORM_EPS


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column, eps: float = NORM_EPS) -> Column:
    """v / (norm + eps). The norm is folded once; only the scalar reaches the inner lambda."""
    v = v.cast("array<double>")
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x * x,
        lambda squares: F.transform(v, lambda x: x / (F.sqrt(squares) + F.lit(eps))),
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def round_weight(w: Column, places: int = 6) -> Column:
    """Half-even rounding of an edge weight."""
    return F.bround(w, places)
