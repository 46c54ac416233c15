"""Units of a dataset folder: what a bounded run lists, sizes and fetches one by one."""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.budget import data_units, with_videos


@dataclass(frozen=True)
class Unit:
    id: str
    est_bytes: int
    files: tuple[str, ...]


class UnitSource(Protocol):
    def info(self) -> dict:
        """The dataset's ``meta/info.json``."""

    def units(self, spark: SparkSession) -> Iterator[Unit]:
        """Units in order of their names, one at a time."""

    def fetch(self, unit: Unit, dest: Path) -> int:
        """Copy a unit and the metadata below ``dest``; returns the bytes written."""


@dataclass(frozen=True)
class FolderSource:
    """A folder in the layout of a dataset.  A unit is a data file with the videos its template names, or a whole chunk."""

    root: Path
    by: str = "file"

    def info(self) -> dict:
        return json.loads((Path(self.root) / "meta" / "info.json").read_text(encoding="utf-8"))

    def units(self, spark: SparkSession) -> Iterator[Unit]:
        root = Path(self.root)
        listed = [(p.relative_to(root).as_posix(), p.stat().st_size) for top in ("data", "videos") for p in (root / top).rglob("*") if p.is_file()]
        files = spark.createDataFrame(listed, "path string, size bigint")
        if self.by == "chunk":
            chunk = F.regexp_extract("path", "^data/chunk-([^/]+)/", 1)
            own = files.filter(F.col("path").endswith(".parquet") & (chunk != "")).groupBy(chunk.alias("unit"))
            rows = own.agg(F.sum("size").alias("size"), F.array_sort(F.collect_list("path")).alias("files"))
        else:
            info = self.info()
            keys = sorted(k for k, v in (info.get("features") or {}).items() if v.get("dtype") in ("video", "image"))
            found = with_videos(data_units(files), files, info.get("video_path") or "", keys)
            rows = found.select("unit", "size", F.concat(F.array("path"), "videos").alias("files"))
        for r in rows.orderBy("unit", "files").toLocalIterator():
            yield Unit(r["unit"], r["size"], tuple(r["files"]))

    def fetch(self, unit: Unit, dest: Path) -> int:
        root, dest = Path(self.root), Path(dest)
        meta = [f"meta/{n}" for n in ("info.json", "tasks.parquet", "tasks.jsonl", "stats.json")]
        for name in (*meta, *unit.files):
            if (root / name).exists():  # a camera may be absent for some units
                (dest / name).parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(root / name, dest / name)
        return sum(p.stat().st_size for p in dest.rglob("*") if p.is_file())
