"""Calibration: pooled robust statistics per dimension and score thresholds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import row_score
from ..sources.frames import Frames
from .jerk import with_jerk
from .quantiles import by_column, exact_percentiles, long_percentiles

#: Scales a median absolute deviation to a standard deviation.  Fixed value.
MAD_TO_STD = 1.4826


@dataclass(frozen=True)
class Calibration:
    """Small, and always on the driver: gates take it as literals.  Field names are those of the stored file, fixed."""

    source: str
    n_frames: int
    anomaly_percentile: float
    jerk_center: list[float] = field(default_factory=list)
    jerk_scale: list[float] = field(default_factory=list)
    action_center: list[float] = field(default_factory=list)
    action_scale: list[float] = field(default_factory=list)
    jerk_score_threshold: float = 0.0
    action_score_threshold: float = 0.0

    def fits(self, signal_dims: int, action_dims: int) -> bool:
        return len(self.jerk_center) == signal_dims and len(self.action_center) == action_dims

    def fitting(self, signal_dims: Column, action_dims: Column) -> Column:
        """The same of columns."""
        return (signal_dims == len(self.jerk_center)) & (action_dims == len(self.action_center))

    def save(self, path: str | Path) -> None:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")

    @staticmethod
    def load(path: str | Path) -> Calibration:
        return Calibration(**json.loads(Path(path).read_text(encoding="utf-8")))


def rint6(x: float) -> float:
    return round(x * 1e6) / 1e6 if x == x and abs(x) < 1e300 else x


def center_scale(df: DataFrame, cols: list[Column]) -> tuple[list[float], list[float], list[int]]:
    """Median and scaled median absolute deviation of each column, nulls passed over, and how many values it has.

    NaN for a column that holds a NaN or nothing.  All columns together: counts,
    medians, and the deviations from them; exact at any size.
    """
    if not cols:
        return [], [], []
    found = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("x", lambda c: F.count_if(F.isnan(c))))]).first()
    counts = [found[f"n{i}"] for i in range(len(cols))]
    clean = [i for i in range(len(cols)) if counts[i] and not found[f"x{i}"]]
    center, scale = [float("nan")] * len(cols), [float("nan")] * len(cols)
    rows = [counts[i] for i in clean]
    for i, m in zip(clean, exact_percentiles(df, [(cols[i], 0.5) for i in clean], rows)):
        center[i] = m
    for i, m in zip(clean, exact_percentiles(df, [(F.abs(cols[i] - F.lit(center[i])), 0.5) for i in clean], rows)):
        scale[i] = m * MAD_TO_STD
    return center, scale, counts


def list_center_scale(df: DataFrame, column: str, dims: int) -> tuple[list[float], list[float]]:
    """The same for a column of lists of so many doubles, however many they are: values are aggregated by their place."""
    rows = df.select(F.posexplode(column).alias("k", "v")).filter("v is not null")
    found = {r["k"]: r for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.count_if(F.isnan("v")).alias("nan")).collect()}  # a row a dimension
    clean = [k for k in range(dims) if k in found and not found[k]["nan"]]
    center, scale = [float("nan")] * dims, [float("nan")] * dims
    if clean:
        place = F.array_position(F.array(*map(F.lit, clean)), F.col("k")).cast("int") - 1
        own = rows.filter(F.col("k").isin(clean)).select(place.alias("k"), "v")
        half, counts = [0.5] * len(clean), [found[k]["n"] for k in clean]
        mid = long_percentiles(own, half, counts)
        off = long_percentiles(own.withColumn("v", F.abs(F.col("v") - by_column(mid))), half, counts)
        for k, c, m in zip(clean, mid, off):
            center[k], scale[k] = c, m * MAD_TO_STD
    return center, scale


def calibrate(frames: Frames, source: str, percentile: float = 99.9, hot_rows: int | None = None) -> Calibration:
    """Statistics pooled over all frames.  The jerk table is cached while it is read several times.

    Raises on frames without any jerk or action: there is nothing to calibrate on.
    """
    jerked = with_jerk(frames, hot_rows).df.select(
        "rn", *[F.col(c) for c in frames.action], *[F.col(f"j_{c}") for c in frames.signal]
    ).persist()
    try:
        moving = F.col("rn") > 3
        jerk = [F.when(moving, F.col(f"j_{c}")) for c in frames.signal]
        action = [F.col(c) for c in frames.action]
        center, scale, counts = center_scale(jerked, jerk + action)
        if not counts or not counts[0] or not counts[-1]:
            raise ValueError(f"{source}: too few frames to calibrate on")
        d = len(jerk)
        jc, js, ac, sc = center[:d], scale[:d], center[d:], scale[d:]
        scores = [F.when(moving, row_score([F.col(f"j_{c}") for c in frames.signal], jc, js)), row_score(action, ac, sc)]
        jt, at = exact_percentiles(jerked, [(s, percentile / 100) for s in scores], [counts[0], counts[-1]])
    finally:
        jerked.unpersist()
    six = lambda xs: [rint6(x) for x in xs]
    return Calibration(source, counts[-1], float(percentile), six(jc), six(js), six(ac), six(sc), round(jt, 6), round(at, 6))
