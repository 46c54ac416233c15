"""Curation and quarantine: what passes, what fails and why, and a few frames of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .budget import running_sum

SAMPLE_FRAMES = 5


def passing(frames: DataFrame, judged: DataFrame, ep: str = "episode_index") -> DataFrame:
    """Rows of episodes that passed."""
    good = judged.filter("passed").select(F.col("ep").alias(ep))
    return frames.join(good, ep, "left_semi")


def rejects(judged: DataFrame) -> DataFrame:
    """``episode_index, reasons`` of failing episodes, in order."""
    return judged.filter(~F.col("passed")).select(F.col("ep").alias("episode_index"), "reasons").orderBy("episode_index")


def samples(frames: DataFrame, judged: DataFrame, order: list[str], ep: str = "episode_index", n: int = SAMPLE_FRAMES) -> DataFrame:
    """The first frames of each failing episode: the rank filter is applied before the shuffle too."""
    bad = judged.filter(~F.col("passed")).select(F.col("ep").alias(ep))
    rows = frames.join(bad, ep, "left_semi")
    w = Window.partitionBy(ep).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def capped(sized: DataFrame, cap: float, order: list[str] | str = "episode_index", size: str = "size") -> DataFrame:
    """Rows in order for as long as what came before them is below the cap; totals are taken over ranges of the order."""
    order = [order] if isinstance(order, str) else list(order)
    total = running_sum(sized, order, F.col(size), "_total")
    return total.filter(F.col("_total") - F.col(size) < F.lit(cap)).drop("_total")
