"""Whole bounded runs: the synthetic proof, and a folder with the calibration that fits it."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import QualityGates, Source
from ..operators.budget import ScaleReport
from ..sources.dataset import declared_dims
from .evict import resolve_calibration, run_scale
from .source import FolderSource
from .synthetic import synthetic_store, unit_calibration


def run_synthetic_scale(spark: SparkSession, data_root: str | Path, *, seed: int = 0, max_units: int | None = None, budget_bytes: int | None = None, **how) -> ScaleReport:
    """The seeded proof: four times the budget goes through it."""
    root = Path(data_root)
    store = root / "_synth_store"
    if store.exists():
        shutil.rmtree(store)
    synthetic_store(spark, store, seed=seed, **how)
    total = sum(p.stat().st_size for p in (store / "data").rglob("*") if p.is_file())
    return run_scale(
        spark, FolderSource(store, by="chunk"), data_root=root, budget_bytes=budget_bytes or total // 4, calibration=unit_calibration(), max_units=max_units,
        scale_id="synthetic", dataset_version="v0.0.0-synthetic-scale", license="synthetic (generated)",
    )


def run_folder_scale(
    spark: SparkSession, source: Source, folder: str | Path, *, data_root: str | Path, gates: QualityGates, budget_bytes: int, max_units: int | None = None,
    catalog_backend: str = "sqlite", catalog_target: str | Path | None = None,
) -> ScaleReport:
    """A mirrored source.  The calibration of ``calibrate_from`` if it fits, else the source's own, else one from its first files."""
    root, units = Path(data_root), FolderSource(Path(folder))
    calibration = resolve_calibration(
        spark, folder, root / "calibration", dims=declared_dims(units.info()), names=(gates.signal.calibrate_from or source.id, source.id),
        percentile=gates.signal.anomaly_percentile,
    )
    return run_scale(
        spark, units, data_root=root, budget_bytes=budget_bytes, calibration=calibration, gates=gates.signal, max_units=max_units, scale_id=source.id,
        dataset_version=f"v0.1.0-{source.id}", hf_repo=source.hf_repo, license=source.license, catalog_backend=catalog_backend, catalog_target=catalog_target,
    )
