"""Schema gate: is what a dataset declares enough, and is it there?

Both a driver-side check of one dataset and a relational one over many.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QualityGates
from ..sources import Dataset

#: Types of features that are files, not columns.  Fixed values, as are the texts of the reasons below.
IMAGE_TYPES = ("image", "video")


@dataclass(frozen=True)
class SchemaResult:
    passed: bool
    codebase_version: str | None
    present_features: list[str]
    reasons: list[str]


def judge(features: dict[str, dict], has_tasks: bool, columns: list[str] | None, gates: QualityGates) -> list[str]:
    """Reasons in the order required, image, language, data; a feature lacking in both places gets two."""
    g = gates.schema
    out = [f"missing required feature '{f}'" for f in g.required_features if f not in features]
    if g.require_at_least_one_image and not set(g.image_keys_any_of) & set(features):
        out.append(f"no image feature present (none of {list(g.image_keys_any_of)})")
    spoken = ("task_index" in features and has_tasks) or "language_instruction" in features or "task" in features
    if gates.require_language_instruction and not spoken:
        out.append("no resolvable language instruction (task_index+tasks table or language_instruction)")
    if columns is None:
        return [*out, "no data parquet found under data/"]
    for f in g.required_features:
        if (features.get(f) or {}).get("dtype") not in IMAGE_TYPES and f not in columns:
            out.append(f"required feature '{f}' declared but not a data column")
    return out


def validate(spark: SparkSession, dataset: Dataset, gates: QualityGates) -> SchemaResult:
    info = dataset.info()
    features = info.get("features") or {}
    tasks = any((dataset.root / "meta" / f"tasks.{x}").exists() for x in ("parquet", "jsonl"))
    reasons = judge(features, tasks, dataset.data_columns(spark), gates)
    return SchemaResult(not reasons, info.get("codebase_version"), sorted(features), reasons)


def lacking(required: Sequence[str], features: Column | str) -> Column:
    """Required features that an array of declared ones has not, in their order."""
    return F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), features)


def validate_many(listed: DataFrame, gates: QualityGates) -> DataFrame:
    """``dataset, passed, reasons`` from ``dataset, features array<string>, image_features array<string>,
    columns array<string>, has_tasks boolean``: the same rules on a table of declarations."""
    g = gates.schema
    have = lambda name: F.array_contains("features", name)
    said = []
    if g.require_at_least_one_image:
        any_of = F.array(*[F.lit(x) for x in g.image_keys_any_of]) if g.image_keys_any_of else F.array().cast("array<string>")
        said.append(F.when(~F.arrays_overlap("features", any_of), f"no image feature present (none of {list(g.image_keys_any_of)})"))
    if gates.require_language_instruction:
        spoken = (have("task_index") & F.col("has_tasks")) | have("language_instruction") | have("task")
        said.append(F.when(~spoken, "no resolvable language instruction (task_index+tasks table or language_instruction)"))
    said.append(F.when(F.col("columns").isNull(), "no data parquet found under data/"))
    for f in g.required_features:
        lacks = F.col("columns").isNotNull() & ~F.array_contains("image_features", f) & ~F.array_contains("columns", f)
        said.append(F.when(lacks, f"required feature '{f}' declared but not a data column"))
    first = F.transform(lacking(g.required_features, "features"), lambda f: F.concat(F.lit("missing required feature '"), f, F.lit("'")))
    out = listed.withColumn("reasons", F.concat(first, F.array_compact(F.array(*said))))
    return out.select("dataset", (F.size("reasons") == 0).alias("passed"), "reasons")
