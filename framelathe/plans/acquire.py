"""Selective acquisition of a dataset folder under a byte budget."""

from __future__ import annotations

import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..log import log_event
from ..operators.budget import Guard, acquisition


@dataclass(frozen=True)
class Acquired:
    files: int
    bytes: int
    stopped_at: str | None


def acquire(spark: SparkSession, origin: str | Path, dest: str | Path, guard: Guard, *, dry_run: bool = False) -> Acquired:
    """Copy files of ``origin``, meta first, then data, then videos, until the budget would be exceeded.

    The stop is projected from listed sizes, so a dry run says what a real one does.
    """
    origin, dest = Path(origin), Path(dest)
    listed = [(str(p.relative_to(origin)), p.stat().st_size) for p in origin.rglob("*") if p.is_file()]
    files = spark.createDataFrame(listed, "path string, size bigint")
    plan = acquisition(files, guard.budget_bytes, guard.used()).orderBy("total", "path").collect()  # the listing, as it came
    taken = [r for r in plan if r["accepted"]]
    refused = next((r["path"] for r in plan if not r["accepted"]), None)
    for r in taken:
        if not dry_run:
            (dest / r["path"]).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(origin / r["path"], dest / r["path"])
        log_event("would_pull" if dry_run else "pulled", path=r["path"], bytes=r["size"])
    done = Acquired(len(taken), sum(r["size"] for r in taken), refused)
    log_event("acquire_done", files=done.files, bytes=done.bytes, stopped_at=refused, dry_run=dry_run)
    return done
