"""Vector arithmetic as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(a, lambda x: F.coalesce(x.cast("double") / F.nullif(norm(a), F.lit(0.0)), F.lit(0.0)))
