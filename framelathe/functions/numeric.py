"""Numbers: rounding rules, ratios and robust z-scores, all inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def half_even(c: Column, places: int) -> Column:
    """Scalar rounding: ties to even."""
    return F.bround(c, places)


def half_even_int(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole; of integers, so the result doesn't depend on row order."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def nan_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def finite_or_zero(c: Column) -> Column:
    """|c|, but 0 for null, NaN and both infinities."""
    a = F.abs(c)
    return F.when(a.isNull() | F.isnan(a) | (a == INF), F.lit(0.0)).otherwise(a)


def robust_z(value: Column, center: float, scale: float) -> Column:
    """|value - center| / scale; a dimension without spread, or without finite statistics, scores 0."""
    if scale == 0 or math.isnan(scale) or math.isnan(center):
        return F.lit(0.0)
    return finite_or_zero((value - F.lit(float(center))) / F.lit(float(scale)))


def row_score(values: Sequence[Column], center: Sequence[float], scale: Sequence[float]) -> Column:
    """The largest robust z over the dimensions; 0 without any."""
    if len(values) != len(center) or len(values) != len(scale):
        raise ValueError(f"{len(values)} dimensions, but statistics of {len(center)} and {len(scale)}")
    z = [robust_z(v, c, s) for v, c, s in zip(values, center, scale)]
    return F.lit(0.0) if not z else z[0] if len(z) == 1 else F.greatest(*z)


def list_score(column: str, center: Sequence[float], scale: Sequence[float]) -> Column:
    """The same of a column of lists; 0 for an empty one."""
    ok = [math.isfinite(c) and math.isfinite(s) and s != 0 for c, s in zip(center, scale)]
    mid, wide = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ([c if k else 0.0 for c, k in zip(center, ok)], [s if k else math.inf for s, k in zip(scale, ok)]))
    z = F.transform(column, lambda v, i: finite_or_zero((v - F.get(mid, i)) / F.get(wide, i)))
    return F.coalesce(F.array_max(z), F.lit(0.0))
