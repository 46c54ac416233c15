"""A dataset directory: ``meta/info.json``, task names, ``data/**/*.parquet``, ``videos/**``.

Metadata is small and read on the driver; data only ever becomes a DataFrame.
Directories of chunks are not partitions, so data is read recursively.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Frames, from_arrays


def declared_dims(info: dict) -> tuple[int, int]:
    """Declared widths of state and action; 0 where not declared."""
    features = info.get("features") or {}
    width = lambda k: int(((features.get(k) or {}).get("shape") or [0])[0])
    return width("observation.state"), width("action")


@dataclass(frozen=True)
class Dataset:
    root: Path

    def __init__(self, root: str | Path):
        object.__setattr__(self, "root", Path(root))

    def info(self) -> dict:
        path = self.root / "meta" / "info.json"
        if not path.exists():
            raise FileNotFoundError(f"no meta/info.json under {self.root}: not a dataset")
        return json.loads(path.read_text(encoding="utf-8"))

    def exists(self) -> bool:
        return (self.root / "meta" / "info.json").exists()

    def files(self) -> list[Path]:
        return sorted((self.root / "data").rglob("*.parquet"))

    def dims(self) -> tuple[int, int]:
        return declared_dims(self.info())

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(self.root / "data"))

    def frames(self, spark: SparkSession) -> Frames:
        return from_arrays(self.data(spark), *self.dims())

    def data_columns(self, spark: SparkSession) -> list[str] | None:
        """Columns of the first data file, from its footer; null without data."""
        files = self.files()
        return spark.read.parquet(str(files[0])).columns if files else None

    def tasks(self, spark: SparkSession) -> DataFrame:
        """``task_index, task``; the name is ``task``, else ``__index_level_0__``, else any other column, else made up.

        Both ``tasks.parquet`` and ``tasks.jsonl`` are read; without either the table is empty.
        """
        empty = spark.createDataFrame([], "task_index bigint, task string")
        for name, read in (("tasks.parquet", spark.read.parquet), ("tasks.jsonl", spark.read.json)):
            path = self.root / "meta" / name
            if path.exists():
                df = read(str(path))
                return task_names(df) if "task_index" in df.columns else empty
        return empty


def task_names(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c != "task_index"]
    name = next((c for c in ("task", "__index_level_0__") if c in others), others[0] if others else None)
    index = F.col("task_index").cast("bigint")
    made = F.concat(F.lit("task_"), index.cast("string"))
    return df.select(index.alias("task_index"), (F.coalesce(F.col(f"`{name}`").cast("string"), made) if name else made).alias("task"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, size`` of every file below root; only the listing is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return df.select("path", F.col("length").alias("size"))
