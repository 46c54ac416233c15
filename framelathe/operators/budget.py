"""Byte budgets: admission of files and units, resumption, and the report of a run.

Running totals over one ordering are taken in two levels (totals of ranges, then
within a range), so no task sees all rows.
"""

from __future__ import annotations

import re
import shutil
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunk_and_file, path_class, render_template, unit_id
from ..functions.text import class_rank

GIB = 1024**3


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, ranges: int = 64) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` from the first row in order up to this one.

    Rows fall into ranges of the order, whose bounds are rows drawn by hash; a
    range adds what the ranges before it hold, which is one row per range.
    """
    drawn = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(ranges - 1).collect()  # bounded
    key = F.struct(*order)
    kinds = dict(df.select(*order).dtypes)
    bounds = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, r)]) for r in sorted(drawn)])
    at = F.size(F.filter(bounds, lambda b: b <= key)) if drawn else F.lit(0)
    dealt = df.withColumns({"_value": value, "_range": at})
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("_own", F.sum("_value").over(w))
    joined = inside.join(F.broadcast(before), "_range")  # at most ``ranges`` rows
    return joined.withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_value", "_own", "_before")


def acquisition(files: DataFrame, budget: int, baseline: int = 0) -> DataFrame:
    """``path, size, class, total, accepted``: meta, data, video, other, each by path, until one would exceed the budget.

    Sizes are not negative, so the total only grows: what follows the first
    refused file is refused with it.
    """
    sized = files.select("path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).withColumns(
        {"class": path_class(F.col("path")), "rank": class_rank(F.col("path"))}
    )
    out = running_sum(sized, ["rank", "path"], F.col("size"), "total")
    return out.select("path", "size", "class", "total", (F.col("total") + F.lit(baseline) <= F.lit(budget)).alias("accepted"))


def file_size(size: Column, lfs_size: Column) -> Column:
    return F.coalesce(F.nullif(size, F.lit(0)), F.nullif(lfs_size, F.lit(0)), F.lit(0)).cast("bigint")


def data_units(files: DataFrame) -> DataFrame:
    """``unit, path, size`` of Parquet files under ``data/``."""
    chunk, file = chunk_and_file(F.col("path"))
    return files.filter(F.col("path").startswith("data/") & F.col("path").endswith(".parquet")).select(
        unit_id(chunk, file).alias("unit"), "path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), chunk.alias("chunk"), file.alias("file")
    )


def with_videos(units: DataFrame, files: DataFrame, template: str, keys: list[str]) -> DataFrame:
    """``units`` with ``videos``, the paths that the template names for each camera, and ``size`` with those that are listed.

    The template may name chunk and file as any version of the format does, padded as it says.
    """
    pads = {name: int(pad or 1) for name, pad in re.findall(r"\{(\w+)(?::0(\d+)d)?\}", template)}
    of = {"chunk": "chunk", "file": "file", "chunk_index": "chunk", "file_index": "file", "episode_chunk": "chunk", "episode_index": "file"}
    values = {name: (F.col(of[name]), pad) for name, pad in pads.items() if name in of}
    videos = [render_template(F.replace(F.lit(template), F.lit("{video_key}"), F.lit(k)), values) for k in keys] if template else []
    units = units.withColumn("videos", F.array(*videos).cast("array<string>"))
    sizes = files.select(F.col("path").alias("_video"), F.col("size").alias("_size"))
    found = units.select("path", F.explode("videos").alias("_video")).join(sizes, "_video").groupBy("path").agg(F.sum("_size").alias("_more"))
    return units.join(found, "path", "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_more")


def preadmit(units: DataFrame, budget: int, headroom: float = 0.9, size: str = "size") -> DataFrame:
    """Adds ``refused``: a unit that alone exceeds the budget with its headroom is listed, not dropped silently."""
    return units.withColumn("refused", F.col(size) > F.lit(budget * headroom))


def pending(units: DataFrame, manifest: DataFrame, key: str = "unit", most: int | None = None) -> DataFrame:
    """Units not in the manifest, the first ``most`` of them."""
    left = units.join(manifest.select(key), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)


def admits(used: int, n: int, budget: int) -> bool:
    return used + max(0, n) <= budget


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Guard:
    """Bytes below a folder against a budget in GiB."""

    root: Path
    budget_gb: float

    @property
    def budget_bytes(self) -> int:
        return int(self.budget_gb * GIB)

    def used(self) -> int:
        root = Path(self.root)
        return sum(p.stat().st_size for p in root.rglob("*") if p.is_file() and not p.is_symlink()) if root.exists() else 0

    def remaining(self) -> int:
        return max(0, self.budget_bytes - self.used())

    def can_admit(self, n: int) -> bool:
        return admits(self.used(), n, self.budget_bytes)

    def admit(self, n: int, label: str) -> None:
        if not self.can_admit(n):
            raise BudgetExceeded(f"{label}: {n} bytes over a budget of {self.budget_bytes} with {self.used()} used")

    def evict(self, path: str | Path) -> int:
        path = Path(path)
        if not path.exists():
            return 0
        if path.is_file():
            size = path.stat().st_size
            path.unlink()
            return size
        size = sum(p.stat().st_size for p in path.rglob("*") if p.is_file())
        shutil.rmtree(path)
        return size

    def usage(self) -> dict:
        used = self.used()
        return {
            "used_gb": round(used / GIB, 4), "remaining_gb": round(self.remaining() / GIB, 4), "budget_gb": self.budget_gb,
            "pct": round(100 * used / self.budget_bytes, 1) if self.budget_bytes else 0.0,
        }


def usage_columns(used: Column, budget: Column) -> dict[str, Column]:
    return {
        "used_gb": F.bround(used / F.lit(float(GIB)), 4),
        "remaining_gb": F.bround(F.greatest(budget - used, F.lit(0)) / F.lit(float(GIB)), 4),
        "pct": F.bround(F.lit(100.0) * used / F.nullif(budget.cast("double"), F.lit(0.0)), 1),
    }


@dataclass(frozen=True)
class ScaleReport:
    budget_bytes: int
    peak_raw_bytes: int
    total_processed_bytes: int
    units_processed: int
    episodes_total: int
    episodes_passed: int
    episodes_quarantined: int

    @property
    def invariant_holds(self) -> bool:
        return self.peak_raw_bytes < self.budget_bytes < self.total_processed_bytes

    def assert_invariant(self) -> None:
        if not self.invariant_holds:
            raise AssertionError(f"peak {self.peak_raw_bytes}, budget {self.budget_bytes}, processed {self.total_processed_bytes}")

    def as_dict(self) -> dict:
        b = self.budget_bytes
        return asdict(self) | {
            "invariant_holds": self.invariant_holds, "budget_mb": round(b / 1e6, 3), "peak_raw_mb": round(self.peak_raw_bytes / 1e6, 3),
            "total_processed_mb": round(self.total_processed_bytes / 1e6, 3), "headroom_ratio": round(self.peak_raw_bytes / b, 3) if b else None,
            "throughput_x_budget": round(self.total_processed_bytes / b, 2) if b else None,
        }


def report(units: DataFrame, budget: int) -> DataFrame:
    """One row from ``unit, bytes, peak, passed, quarantined``: the report's counters and derived figures."""
    got = units.agg(
        F.max("peak").alias("peak_raw_bytes"), F.sum("bytes").alias("total_processed_bytes"), F.count(F.lit(1)).alias("units_processed"),
        F.sum("passed").alias("episodes_passed"), F.sum("quarantined").alias("episodes_quarantined"),
    )
    b = F.lit(budget).cast("bigint")
    over = F.nullif(b.cast("double"), F.lit(0.0))
    return got.withColumns({
        "budget_bytes": b,
        "invariant_holds": (F.col("peak_raw_bytes") < b) & (F.col("total_processed_bytes") > b),
        "budget_mb": F.bround(b / F.lit(1e6), 3), "peak_raw_mb": F.bround(F.col("peak_raw_bytes") / F.lit(1e6), 3),
        "total_processed_mb": F.bround(F.col("total_processed_bytes") / F.lit(1e6), 3),
        "headroom_ratio": F.bround(F.col("peak_raw_bytes") / over, 3), "throughput_x_budget": F.bround(F.col("total_processed_bytes") / over, 2),
    })
