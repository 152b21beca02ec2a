"""Vector arithmetic on ``array<double>`` columns, over the shared length of both sides.

These are for row-wise use. Scoring many chunks against many queries goes through
``operators.vector``, which multiplies Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _doubles(vector: Column) -> Column:
    return F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(_doubles(left), _doubles(right), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    squares = F.transform(_doubles(vector), lambda x: x * x)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine(left: Column, right: Column) -> Column:
    """True cosine over the shared length; 0 when either side has no magnitude there."""
    shared = F.least(F.size(left), F.size(right))
    a, b = F.slice(_doubles(left), F.lit(1), shared), F.slice(_doubles(right), F.lit(1), shared)
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def normalize(vector: Column) -> Column:
    """Unit vector; vectors with zero or non-finite length stay as they are."""
    length = norm(vector)
    usable = (length > 0) & ~F.isnan(length) & (length != float("inf"))
    scaled = F.transform(_doubles(vector), lambda x: x / length)
    return F.when(usable, scaled).otherwise(_doubles(vector))


def recency_boost(mtime: Column, weight: float, now_ms: int, unit_ms: int = 1) -> Column:
    """``weight / (1 + age in days)``.

    With the default ``unit_ms=1`` the stored seconds are taken as milliseconds, as the
    engine's contract has it; ``unit_ms=1000`` is the corrected reading.
    """
    if weight <= 0:
        return F.lit(0.0)
    age = (F.lit(now_ms) - mtime * unit_ms) / F.lit(float(DAY_MS))
    return F.when(age.isNull() | F.isnan(age) | (age <= 0), F.lit(float(weight))).otherwise(
        F.lit(float(weight)) / (1 + age)
    )
