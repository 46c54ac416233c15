"""Signal gates: metrics and verdict of each episode, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SignalGates
from ..functions import half_even, half_even_int, python_float, ratio, row_score
from ..sources.frames import Frames
from .calibrate import Calibration
from .jerk import with_jerk


def missing_ratio(n: Column, duration: Column, fps: float | None, nan_frames: Column) -> Column:
    """The larger of the share of frames that the duration leaves missing, and of frames with a NaN."""
    nan = ratio(nan_frames, n)
    if not fps:
        return nan
    expected = half_even_int(duration * F.lit(float(fps))) + 1
    short = F.when(
        (n > 1) & (duration > 0) & (expected > 0),
        F.greatest(F.lit(0.0), (expected - n).cast("double") / F.nullif(expected.cast("double"), F.lit(0.0))),
    ).otherwise(0.0)
    return F.greatest(short, nan)


def frame_scores(frames: Frames, calibration: Calibration, hot_rows: int | None = None) -> DataFrame:
    """Frames with ``rn``, ``jerk_score`` (null for the first three of an episode) and ``action_score``."""
    if not calibration.fits(len(frames.signal), len(frames.action)):
        raise ValueError(
            f"calibration of {len(calibration.jerk_center)} and {len(calibration.action_center)} dimensions "
            f"for signals of {len(frames.signal)} and {len(frames.action)}"
        )
    df = with_jerk(frames, hot_rows).df
    jerk = row_score([F.col(f"j_{c}") for c in frames.signal], calibration.jerk_center, calibration.jerk_scale)
    action = row_score([F.col(c) for c in frames.action], calibration.action_center, calibration.action_scale)
    return df.withColumns({"jerk_score": F.when(F.col("rn") > 3, jerk), "action_score": action})


def episode_metrics(frames: Frames, calibration: Calibration, fps: float | None = None, hot_rows: int | None = None) -> DataFrame:
    """One row per episode, rounded as verdicts take it: ratios to six places, duration to four."""
    df = frame_scores(frames, calibration, hot_rows)
    clock = F.col(frames.ts).cast("double") if frames.ts else F.lit(None).cast("double")
    nan = F.lit(False)
    for c in frames.signal:
        nan = nan | F.isnan(c)
    by = df.groupBy(F.col(frames.ep).alias("ep")).agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.max_by(clock, "rn") - F.min_by(clock, "rn")).alias("duration"),
        F.count_if(F.col("jerk_score").isNotNull()).alias("n_jerk"),
        F.count_if(F.col("jerk_score") > calibration.jerk_score_threshold).alias("jerk_bad"),
        F.count_if(F.col("action_score") > calibration.action_score_threshold).alias("action_bad"),
        F.count_if(nan).alias("nan_frames"),
    )
    n, duration = F.col("n_frames"), F.when(F.col("n_frames") > 1, F.coalesce("duration", F.lit(0.0))).otherwise(0.0)
    return by.select(
        "ep",
        "n_frames",
        half_even(duration, 4).alias("duration_s"),
        half_even(ratio(F.col("jerk_bad"), F.col("n_jerk")), 6).alias("jerk_anomalous_ratio"),
        half_even(ratio(F.col("action_bad"), n), 6).alias("action_anomalous_ratio"),
        half_even(missing_ratio(n, duration, fps, F.col("nan_frames")), 6).alias("missing_frame_ratio"),
    )


def verdicts(metrics: DataFrame, gates: SignalGates = SignalGates()) -> DataFrame:
    """Metrics with ``reasons`` (in the order jerk, action, missing) and ``passed``; only what exceeds its limit fails."""
    # the texts of reasons are fixed values
    tests = (
        ("jerk-anomalous frames", "jerk_anomalous_ratio", gates.max_anomalous_frame_ratio),
        ("action-anomalous frames", "action_anomalous_ratio", gates.max_anomalous_frame_ratio),
        ("missing-frame ratio", "missing_frame_ratio", gates.max_missing_frame_ratio),
    )
    said = [
        F.when(F.col(c) > F.lit(float(most)), F.concat(F.lit(f"{what} "), python_float(F.col(c)), F.lit(f" > {most!r}"))) for what, c, most in tests
    ]
    return metrics.withColumn("reasons", F.array_compact(F.array(*said))).withColumn("passed", F.size("reasons") == 0)


def summary(judged: DataFrame) -> DataFrame:
    """One row: total, passed, failed and the pass rate to four places (0 without episodes)."""
    got = judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("passed")).alias("passed"))
    return got.select(
        "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), half_even(ratio(F.col("passed"), F.col("total")), 4).alias("pass_rate")
    )


def combined_rate(summaries: DataFrame) -> DataFrame:
    """Pass rate over several summaries; null without episodes."""
    got = summaries.agg(F.sum("passed").alias("p"), F.sum("total").alias("t"))
    return got.select(half_even(F.col("p").cast("double") / F.nullif(F.col("t").cast("double"), F.lit(0.0)), 4).alias("pass_rate"))


def signal_gates(frames: Frames, calibration: Calibration, gates: SignalGates = SignalGates(), fps: float | None = None, hot_rows: int | None = None) -> DataFrame:
    return verdicts(episode_metrics(frames, calibration, fps, hot_rows), gates)
