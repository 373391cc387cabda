"""Vector distances as column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(values) -> Column:
    """A literal vector."""
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2(a, b) -> Column:
    """``<->``"""
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def cosine_unit(a, b) -> Column:
    """``<=>`` for normalised vectors: 1 - dot."""
    return F.lit(1.0) - dot(a, b)


def cosine(a, b) -> Column:
    """1 - cosine, whatever the lengths; null for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - dot(a, b) / F.nullif(size, F.lit(0.0))


def inner_product(a, b) -> Column:
    """``<#>``: the negated inner product, so that smaller is closer."""
    return -dot(a, b)


def hamming(a, b) -> Column:
    """Number of differing components."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


DISTANCES = {"l2": l2, "cosine": cosine, "cosine_unit": cosine_unit, "inner_product": inner_product, "hamming": hamming}
