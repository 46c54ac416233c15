"""Dataset versions: task distribution, records, upsert and what the dashboard reads."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the catalog.  Fixed names.
SCHEMA = (
    "dataset_version string, source_id string, hf_repo string, license string, episode_count bigint, frame_count bigint, "
    "task_distribution string, gate_pass_rate double, bytes_on_disk bigint, git_commit string, created_at string, notes string"
)


def first_tasks(frames: DataFrame, order: list[str], ep: str = "episode_index", task: str = "task_index") -> DataFrame:
    """``ep, task_index``: the task of each episode's first frame; 0 where frames have no task."""
    value = F.min_by(F.col(task), F.struct(*order) if len(order) > 1 else F.col(order[0])) if task in frames.columns else F.lit(0)
    return frames.groupBy(F.col(ep).alias("ep")).agg(F.coalesce(value.cast("bigint") if task in frames.columns else F.max(F.lit(0)), F.lit(0)).cast("bigint").alias("task_index"))


def last_of(names: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key, with the value of the last row that has it."""
    return names.withColumn("_row", F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(value, "_row").alias(value))


def named(tasks_of: DataFrame, names: DataFrame) -> DataFrame:
    """``ep, task``: names looked up, ``task_<i>`` where there is none; of a repeated index the last name counts, in the
    order in which the table is read."""
    one = last_of(names, "task_index", "task")
    made = F.concat(F.lit("task_"), F.col("task_index").cast("string"))
    return tasks_of.join(one, "task_index", "left").select("ep", F.coalesce("task", made).alias("task"))


def task_counts(by_episode: DataFrame) -> DataFrame:
    """``task, episodes``."""
    return by_episode.groupBy("task").agg(F.count(F.lit(1)).alias("episodes"))


def as_map(counts: DataFrame) -> DataFrame:
    """One row ``task_distribution``: a map from task to episodes, keys in order.  As large as the number of tasks."""
    pairs = F.array_sort(F.collect_list(F.struct("task", "episodes")))
    return counts.agg(F.map_from_entries(pairs).alias("task_distribution"))


def record(frames: DataFrame, counts: DataFrame, *, version: str, source: str, ep: str = "episode_index", pass_rate: float | None = None, **more) -> DataFrame:
    """The catalog row of a dataset version; ``more`` sets the columns that data don't tell."""
    size = frames.agg(F.countDistinct(ep).alias("episode_count"), F.count(F.lit(1)).alias("frame_count"))
    tasks = as_map(counts).select(F.to_json("task_distribution").alias("task_distribution"))
    one = size.crossJoin(tasks)  # one row each
    value = {"dataset_version": version, "source_id": source, "gate_pass_rate": pass_rate, "bytes_on_disk": 0} | more
    value.setdefault("created_at", datetime.now(timezone.utc).isoformat())
    have = {"episode_count", "frame_count", "task_distribution"}
    kinds = dict(x.strip().split(" ") for x in SCHEMA.split(","))
    return one.select(*[F.col(c) if c in have else F.lit(value.get(c)).cast(k).alias(c) for c, k in kinds.items()])


def keep_latest(rows: DataFrame, key: str = "dataset_version", seq: str = "seq") -> DataFrame:
    """Of rows with one key the one with the largest ``seq``: an aggregation, no sort."""
    others = [c for c in rows.columns if c not in (key, seq)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("x"))
    return last.select(key, *[F.col(f"x.`{c}`") for c in others])


class Catalog:
    """Catalog as a Parquet folder: a version is replaced by writing the table anew beside it and moving it over."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, Path(path)

    def read(self) -> DataFrame:
        if not self.path.exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(str(self.path))

    def upsert(self, rows: DataFrame) -> None:
        for c in ("dataset_version", "source_id"):
            if rows.filter(F.col(c).isNull()).take(1):
                raise ValueError(f"{c} must not be null")
        both = self.read().withColumn("seq", F.lit(0)).unionByName(rows.withColumn("seq", F.lit(1)))
        fresh = self.path.with_name(self.path.name + ".new")
        old = self.path.with_name(self.path.name + ".old")
        keep_latest(both).select(*[x.strip().split(" ")[0] for x in SCHEMA.split(",")]).coalesce(1).write.mode("overwrite").parquet(str(fresh))
        if self.path.exists():
            self.path.rename(old)
        fresh.rename(self.path)
        if old.exists():
            import shutil

            shutil.rmtree(old)
