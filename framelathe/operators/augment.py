"""Synthetic episodes for tasks that have too few, and merging them in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibrate import Calibration
from .catalog import last_of


def deficits(counts: DataFrame, target: int) -> DataFrame:
    """``task, deficit`` of tasks with fewer than ``target`` episodes; tasks without any are not known here."""
    return counts.filter(F.col("episodes") < target).select("task", (F.lit(target) - F.col("episodes")).alias("deficit"))


def plan(counts: DataFrame, names: DataFrame, *, target: int = 3, cap: int = 20, next_episode: int = 0) -> DataFrame:
    """``episode_index, task, task_index``: episodes to make, in order of task name, at most ``cap`` in all.

    Tasks without an index are left out; of several indices of one name the
    last counts.  Only the first ``cap`` rows in order are kept before they are
    numbered, so the window without partitions sees no more.
    """
    index = last_of(names, "task", "task_index")
    each = deficits(counts, target).join(index, "task").select("task", "task_index", F.explode(F.sequence(F.lit(1), F.col("deficit").cast("int"))).alias("k"))
    rows = each.orderBy("task", "k").limit(cap).withColumn("rn", F.row_number().over(Window.orderBy("task", "k")))
    return rows.select((F.col("rn") - 1 + F.lit(next_episode)).cast("bigint").alias("episode_index"), "task", "task_index")


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    h = F.xxhash64(F.lit(seed), *parts)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def smooth(seed: int, tag: str, dims: int, center: list[float], scale: list[float], ep: str, t: str) -> Column:
    """An array of slow sinusoids around a centre, one per dimension, as floats; ranges of frequency and amplitude are fixed values."""
    out = []
    for d in range(dims):
        u = [uniform(seed, F.lit(f"{tag}:{d}:{k}"), ep) for k in range(3)]
        freq, phase, amp = 0.01 + 0.04 * u[0], 2 * math.pi * u[1], abs(scale[d]) * (0.2 + 0.5 * u[2])
        out.append((F.lit(float(center[d])) + amp * F.sin(freq * F.col(t) + phase)).cast("float"))
    return F.array(*out)


def generate(planned: DataFrame, calibration: Calibration, state_dims: int, action_dims: int, *, fps: float = 15.0, length: tuple[int, int] = (120, 260), seed: int = 0) -> DataFrame:
    """Frames of the planned episodes; every value is a function of seed, episode and dimension, so reruns agree."""
    center, scale = calibration.action_center[:action_dims], calibration.action_scale[:action_dims]
    if len(center) < action_dims:
        center, scale = [0.0] * action_dims, [1.0] * action_dims
    n = F.lit(length[0]) + F.floor(uniform(seed, F.lit("n"), "episode_index") * (length[1] - length[0])).cast("int")
    rows = planned.withColumn("n", n).select("episode_index", "task_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("frame_index"))
    return rows.select(
        smooth(seed, "state", state_dims, [0.0] * state_dims, [1.0] * state_dims, "episode_index", "frame_index").alias("observation.state"),
        smooth(seed, "action", action_dims, center, scale, "episode_index", "frame_index").alias("action"),
        (F.col("frame_index") / F.lit(float(fps))).cast("float").alias("timestamp"),
        "episode_index", "frame_index", "task_index",
    )


def merge(base: DataFrame, added: DataFrame, ep: str = "episode_index") -> DataFrame:
    """Rows of both by column name, missing columns null; ``added`` is renumbered past the largest episode of ``base``."""
    top = base.agg(F.max(ep).alias("_top"))  # one row
    moved = added.crossJoin(F.broadcast(top)).withColumn(ep, F.col(ep) + F.coalesce(F.col("_top"), F.lit(-1)) + 1).drop("_top")
    return base.unionByName(moved, allowMissingColumns=True)
