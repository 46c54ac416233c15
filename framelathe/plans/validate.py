"""Validation of an acquired source: schema gate, calibration, signal gates, curation, quarantine, eviction."""

from __future__ import annotations

import json
import shutil
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QualityGates, SignalGates
from ..log import log_event
from ..operators.budget import Guard
from ..operators.calibrate import Calibration, calibrate
from ..operators.curate import passing
from ..operators.gates import signal_gates, summary
from ..operators.jerk import HOT_ROWS
from ..operators.schema_gate import SchemaResult, validate
from ..sources import Dataset


@dataclass(frozen=True)
class Validation:
    source_id: str
    action: str
    total: int = 0
    passed: int = 0
    pass_rate: float = 0.0
    curated_episodes: int = 0
    curated_frames: int = 0
    evicted_bytes: int = 0


def ingest(spark: SparkSession, source_id: str, data_root: str | Path, gates: QualityGates) -> tuple[str, SchemaResult | None]:
    """``ready``, ``quarantined``, ``dropped`` or ``error`` (nothing acquired); other formats are not supported."""
    root = Path(data_root)
    raw = root / "raw" / source_id
    if not raw.exists():
        log_event("ingest_error", source=source_id)
        return "error", None
    dataset = Dataset(raw)
    if not dataset.exists():
        raise NotImplementedError(f"{source_id}: no meta/info.json, and no conversion of other formats")
    result = validate(spark, dataset, gates)
    log_event("schema_result", source=source_id, passed=result.passed, reasons=result.reasons)
    if result.passed:
        return "ready", result
    if gates.on_fail == "drop":
        shutil.rmtree(raw)
        return "dropped", result
    to = root / "quarantine" / source_id
    if to.exists():
        shutil.rmtree(to)
    to.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(str(raw), str(to))
    said = {"rejected_at": now(), "stage": "schema_gate", "reasons": result.reasons, "codebase_version": result.codebase_version}
    (to / "_rejects.json").write_text(json.dumps(said, indent=2), encoding="utf-8")
    return "quarantined", result


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def calibration_for(spark: SparkSession, dataset: Dataset, source_id: str, gates: QualityGates, data_root: Path) -> Calibration:
    """The stored calibration of ``calibrate_from``, or one built from this source and stored with its real origin."""
    wanted = gates.signal.calibrate_from or source_id
    path = Path(data_root) / "calibration" / f"{wanted}.json"
    if path.exists():
        return Calibration.load(path)
    if wanted != source_id:
        log_event("calibration_fallback", wanted=wanted, using=source_id)
    built = calibrate(dataset.frames(spark), source_id, gates.signal.anomaly_percentile, HOT_ROWS)
    built.save(path)
    return built


def run_signal_gates(spark: SparkSession, root: str | Path, gates: SignalGates, calibration: Calibration) -> DataFrame:
    """Verdicts of a dataset folder's episodes, in order."""
    d = Dataset(root)
    return signal_gates(d.frames(spark), calibration, gates, d.info().get("fps")).orderBy("ep")


def copy_rest(raw: Path, out: Path) -> None:
    """Metadata and videos, as they are."""
    for name in ("tasks.parquet", "tasks.jsonl", "stats.json", "info.json"):
        if (raw / "meta" / name).exists():
            (out / "meta").mkdir(parents=True, exist_ok=True)
            shutil.copy2(raw / "meta" / name, out / "meta" / name)
    for name in ("meta/episodes", "videos"):
        if (raw / name).exists():
            shutil.copytree(raw / name, out / name, dirs_exist_ok=True)


def set_totals(root: Path, episodes: int, frames: int) -> None:
    path = root / "meta" / "info.json"
    info = json.loads(path.read_text(encoding="utf-8"))
    info |= {"total_episodes": episodes, "total_frames": frames}
    path.write_text(json.dumps(info, indent=2), encoding="utf-8")


def write_data(df: DataFrame, root: Path) -> tuple[int, int]:
    """Write frames under ``root/data`` and count episodes and frames of what was written."""
    df.write.mode("overwrite").parquet(str(root / "data"))
    got = df.sparkSession.read.parquet(str(root / "data")).agg(F.countDistinct("episode_index"), F.count(F.lit(1))).first()
    return got[0], got[1]


def run_validation(spark: SparkSession, source_id: str, guard: Guard, data_root: str | Path, gates: QualityGates) -> Validation:
    root = Path(data_root)
    action, _ = ingest(spark, source_id, root, gates)
    if action != "ready":
        return Validation(source_id, action)
    raw, out = root / "raw" / source_id, root / "curated" / source_id
    dataset = Dataset(raw)
    calibration = calibration_for(spark, dataset, source_id, gates, root)
    judged = signal_gates(dataset.frames(spark), calibration, gates.signal, dataset.info().get("fps"), HOT_ROWS).persist()
    try:
        total = summary(judged).first()
        if out.exists():
            shutil.rmtree(out)
        copy_rest(raw, out)
        episodes, frames = write_data(passing(dataset.data(spark), judged), out)
        set_totals(out, episodes, frames)
        bad = judged.filter(~F.col("passed"))
        if total["failed"]:
            to = root / "quarantine" / source_id
            to.mkdir(parents=True, exist_ok=True)
            bad.select(F.col("ep").alias("episode_index"), "reasons").write.mode("overwrite").json(str(to / "episode_rejects"))
            (to / "episode_rejects.meta.json").write_text(json.dumps({"rejected_at": now(), "stage": "signal_gates"}), encoding="utf-8")
    finally:
        judged.unpersist()
    freed = guard.evict(raw)
    log_event("batch_metrics", source=source_id, gate_pass_rate=total["pass_rate"], episodes_total=total["total"], raw_bytes_evicted=freed)
    return Validation(source_id, "ready", total["total"], total["passed"], total["pass_rate"], episodes, frames, freed)
