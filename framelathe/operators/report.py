"""What the dashboard shows: versions, pass rates, the task mix of one version, and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_COLUMNS = ("dataset_version", "source_id", "episode_count", "frame_count", "gate_pass_rate", "bytes_on_disk", "created_at")


def versions(catalog: DataFrame) -> DataFrame:
    return catalog.select(*VERSION_COLUMNS).orderBy("dataset_version")


def pass_rates(catalog: DataFrame) -> DataFrame:
    return catalog.filter("gate_pass_rate is not null").select("dataset_version", "gate_pass_rate").orderBy("dataset_version")


def task_mix(catalog: DataFrame, version: str) -> DataFrame:
    """``task, episodes`` of one version, most episodes first."""
    tasks = F.from_json("task_distribution", "map<string,bigint>")
    one = catalog.filter(F.col("dataset_version") == version).select(F.explode(tasks).alias("task", "episodes"))
    return one.orderBy(F.desc("episodes"), "task")


def totals(catalog: DataFrame) -> DataFrame:
    """``dataset_version, tasks, episodes`` from the stored distributions."""
    tasks = F.from_json("task_distribution", "map<string,bigint>")
    summed = F.aggregate(F.map_values(tasks), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return catalog.select("dataset_version", F.size(tasks).cast("bigint").alias("tasks"), summed.alias("episodes"))


def storage(reports: DataFrame) -> DataFrame:
    """Progress of peak against budget (at most 1), and the percentage."""
    share = F.col("peak_raw_bytes") / F.nullif(F.col("budget_bytes").cast("double"), F.lit(0.0))
    return reports.withColumns({"progress": F.least(F.lit(1.0), share), "pct_of_budget": F.bround(share * 100, 1)})


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest documents of a folder; unreadable ones are skipped."""
    schema = (
        "dataset_version string, budget_bytes bigint, processed_units array<string>, processed_episodes array<bigint>, "
        "total_processed_bytes bigint, peak_raw_bytes bigint, episodes_passed bigint, episodes_quarantined bigint"
    )
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
