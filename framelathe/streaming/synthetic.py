"""A synthetic store of units, made by Spark: waves with a little noise, and a chatter on one dimension of every so many episodes."""

from __future__ import annotations

import json
import math
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.augment import uniform
from ..operators.calibrate import Calibration

#: Frames a second, tasks and their names.  Fixed values.
FPS = 10
TASKS = ("a", "b", "c", "d")


def unit_calibration(signal: int = 14, action: int = 7) -> Calibration:
    """Centre 0 and scale 1 everywhere; the thresholds 6 and 5 are fixed values."""
    return Calibration("synthetic", 10_000, 99.9, [0.0] * signal, [1.0] * signal, [0.0] * action, [1.0] * action, 6.0, 5.0)


def waves(seed: int, tag: str, dims: int, wave, period: float) -> Column:
    """An array of one wave a dimension, each a radian on, with normal noise of 0.01, as floats."""
    out = []
    for d in range(dims):
        u, v = (uniform(seed, F.lit(f"{tag}:{d}:{k}"), "episode_index", "frame_index") for k in (0, 1))
        noise = F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * math.pi * v) * 0.01
        out.append((wave(F.col("frame_index") / F.lit(period) + F.lit(float(d))) + noise).cast("float"))
    return F.array(*out)


def synthetic_frames(spark: SparkSession, *, chunks: int = 8, eps_per_chunk: int = 3, frames: int = 1200, bad_every: int = 7, seed: int = 0, dims: int = 7) -> DataFrame:
    """``unit`` and frame columns; the first of every ``bad_every`` episodes chatters by 50 over max(6, 5%) frames from its middle on."""
    eps = spark.range(chunks * eps_per_chunk).select(F.col("id").alias("episode_index"))
    rows = eps.select("episode_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(frames - 1).cast("bigint"))).alias("frame_index"))
    bad = (F.col("episode_index") % bad_every) == 0
    place = F.col("frame_index") - frames // 2
    inside = (place >= 0) & (place < max(6, frames // 20))
    kick = F.when(bad & inside, F.when(place % 2 == 0, 50.0).otherwise(-50.0)).otherwise(0.0)
    rows = rows.withColumns({"_action": waves(seed, "action", dims, F.cos, 6.0), "_kick": kick})
    action = F.transform("_action", lambda x, i: F.when(i == 0, x + F.col("_kick")).otherwise(x).cast("float"))
    return rows.select(
        F.format_string("%03d", (F.col("episode_index") / eps_per_chunk).cast("int")).alias("unit"),
        waves(seed, "state", dims, F.sin, 5.0).alias("observation.state"),
        action.alias("action"),
        (F.col("frame_index") / F.lit(float(FPS))).cast("float").alias("timestamp"),
        "episode_index", "frame_index", (F.col("episode_index") % len(TASKS)).alias("task_index"),
    )


def synthetic_store(spark: SparkSession, store: str | Path, **how) -> None:
    """One chunk folder per unit under ``store/data``, and the metadata."""
    store = Path(store)
    rows = synthetic_frames(spark, **how)
    tmp = store / "_units"
    rows.repartition("unit").sortWithinPartitions("unit", "episode_index", "frame_index").write.partitionBy("unit").mode("overwrite").parquet(str(tmp))
    for folder in sorted(tmp.glob("unit=*")):
        to = store / "data" / f"chunk-{folder.name.removeprefix('unit=')}"
        to.mkdir(parents=True, exist_ok=True)
        for k, part in enumerate(sorted(folder.glob("*.parquet"))):
            part.rename(to / f"file-{k:03d}.parquet")
    shutil.rmtree(tmp)
    (store / "meta").mkdir(parents=True, exist_ok=True)
    # names of features and keys of the metadata are fixed
    shape, one = {"dtype": "float32", "shape": [how.get("dims", 7)]}, {"dtype": "int64", "shape": [1]}
    features = {"observation.state": shape, "action": shape, "timestamp": {"dtype": "float32", "shape": [1]}, "episode_index": one, "frame_index": one, "task_index": one}
    features["observation.images.cam"] = {"dtype": "video", "shape": [8, 8, 3]}
    (store / "meta" / "info.json").write_text(json.dumps({"codebase_version": "v3.0", "fps": FPS, "features": features}), encoding="utf-8")
    names = "".join(json.dumps({"task_index": k, "task": t}) + "\n" for k, t in enumerate(TASKS))
    (store / "meta" / "tasks.jsonl").write_text(names, encoding="utf-8")
