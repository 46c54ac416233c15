"""Acquire, validate, catalog, augment, validate again with the same gates, merge, catalog."""

from __future__ import annotations

import json
import shutil
import subprocess
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import QualityGates, Source
from ..log import log_event
from ..operators import augment, catalog
from ..operators.budget import Guard
from ..operators.calibrate import Calibration
from ..operators.catalog_store import open_catalog
from ..sources import Dataset
from .acquire import acquire
from .validate import copy_rest, run_validation, set_totals, write_data


def git_commit() -> str | None:
    try:
        return subprocess.check_output(["git", "rev-parse", "--short", "HEAD"], text=True, stderr=subprocess.DEVNULL, timeout=10).strip()
    except (OSError, subprocess.SubprocessError):
        return None


def counts_of(spark: SparkSession, dataset: Dataset):
    data = dataset.data(spark)
    order = [c for c in ("frame_index", "timestamp") if c in data.columns]
    return catalog.task_counts(catalog.named(catalog.first_tasks(data, order), dataset.tasks(spark)))


def record_of(spark: SparkSession, dataset: Dataset, version: str, source: Source, pass_rate: float | None, notes: str):
    size = sum(p.stat().st_size for p in dataset.root.rglob("*") if p.is_file())
    return catalog.record(
        dataset.data(spark), counts_of(spark, dataset), version=version, source=source.id, pass_rate=pass_rate, bytes_on_disk=size,
        hf_repo=source.hf_repo, license=source.license, git_commit=git_commit(), notes=notes,
    )


def synthesise(spark: SparkSession, base: Dataset, out: Path, calibration: Calibration, *, target: int, cap: int, seed: int = 0) -> int:
    """Write a dataset of synthetic episodes for tasks with too few; returns how many."""
    info = base.info()
    ds, da = base.dims()
    top = base.data(spark).agg(F.max("episode_index")).first()[0]
    planned = augment.plan(counts_of(spark, base), base.tasks(spark), target=target, cap=cap, next_episode=0 if top is None else top + 1).persist()
    n = planned.count()
    if out.exists():
        shutil.rmtree(out)
    copy_rest(base.root, out)
    if n:
        _, frames = write_data(augment.generate(planned, calibration, ds or 7, da or 7, fps=float(info.get("fps") or 15), seed=seed), out)
        set_totals(out, n, frames)
    planned.unpersist()
    return n


@dataclass(frozen=True)
class Job:
    """What the tasks of one source share.  They pass on nothing but files, so any of them can be run again by itself."""

    spark: SparkSession
    source: Source
    root: Path
    gates: QualityGates
    budget_gb: float = 25.0
    origin: Path | None = None
    target: int = 3
    cap: int = 20
    catalog_backend: str = "parquet"
    catalog_target: Path | None = None

    @property
    def guard(self) -> Guard:
        return Guard(self.root, self.budget_gb)

    @property
    def synthetic(self) -> str:
        return f"{self.source.id}-synth"

    @property
    def merged(self) -> Path:
        return self.root / "curated" / f"{self.source.id}-aug"

    def versions(self):
        file = "catalog.db" if self.catalog_backend == "sqlite" else "catalog"
        return open_catalog(self.spark, self.catalog_backend, self.catalog_target or self.root / file)

    def keep(self, name: str, said: dict) -> dict:
        folder = self.root / "tasks" / self.source.id
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(json.dumps(said), encoding="utf-8")
        return said

    def kept(self, name: str) -> dict:
        path = self.root / "tasks" / self.source.id / f"{name}.json"
        return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def acquire_task(job: Job) -> dict:
    """Copy the source unless it is there."""
    to = job.root / "raw" / job.source.id
    if job.origin is not None and not to.exists():
        acquire(job.spark, job.origin, to, job.guard)
    return {"acquired": to.exists()}


def validate_task(job: Job) -> dict:
    return job.keep("validate", asdict(run_validation(job.spark, job.source.id, job.guard, job.root, job.gates)))


def catalog_real_task(job: Job) -> dict:
    real, version = job.kept("validate"), f"v0.1.0-{job.source.id}"
    base = Dataset(job.root / "curated" / job.source.id)
    job.versions().upsert(record_of(job.spark, base, version, job.source, real.get("pass_rate"), "real"))
    return {"version": version}


def augment_task(job: Job) -> dict:
    """Make episodes, gate them like real ones, and merge what passes."""
    base = Dataset(job.root / "curated" / job.source.id)
    wanted = job.root / "calibration" / f"{job.gates.signal.calibrate_from or job.source.id}.json"
    calibration = Calibration.load(wanted if wanted.exists() else wanted.with_name(f"{job.source.id}.json"))
    real = job.kept("validate")
    made = synthesise(job.spark, base, job.root / "raw" / job.synthetic, calibration, target=job.target, cap=job.cap)
    if job.merged.exists():
        shutil.rmtree(job.merged)
    copy_rest(base.root, job.merged)
    rate, data = real.get("pass_rate"), base.data(job.spark)
    if made:
        done = run_validation(job.spark, job.synthetic, job.guard, job.root, job.gates)
        if done.action == "ready" and done.curated_frames:
            data = augment.merge(data, Dataset(job.root / "curated" / job.synthetic).data(job.spark))
            rate = round((real["passed"] + done.passed) / (real["total"] + done.total), 4)
    episodes, frames = write_data(data, job.merged)
    set_totals(job.merged, episodes, frames)
    return job.keep("augment", {"generated": made, "combined_pass_rate": rate})


def catalog_aug_task(job: Job) -> dict:
    if not job.merged.exists():
        return {}
    done, version = job.kept("augment"), f"v0.2.0-{job.source.id}-aug"
    notes = f"{done.get('generated', 0)} synthetic episodes"
    job.versions().upsert(record_of(job.spark, Dataset(job.merged), version, job.source, done.get("combined_pass_rate"), notes))
    return {"version": version}


#: In the order in which each needs the one before it.
TASKS = (("acquire", acquire_task), ("validate", validate_task), ("catalog_real", catalog_real_task), ("augment", augment_task), ("catalog_aug", catalog_aug_task))


def run_tasks(job: Job, names: list[str] | None = None) -> dict[str, dict]:
    """Run the tasks, or those named, in order; stops where a source isn't ready."""
    out = {}
    for name, task in TASKS:
        if names is None or name in names:
            out[name] = task(job)
            log_event("task_done", task=name, source=job.source.id, **out[name])
            if name == "validate" and out[name]["action"] != "ready":
                break
    return out


def run_pipeline(
    spark: SparkSession, source: Source, *, data_root: str | Path, gates: QualityGates, budget_gb: float = 25.0, origin: str | Path | None = None,
    do_augment: bool = True, target_per_task: int = 3, max_new_episodes: int = 20, catalog_backend: str = "parquet", catalog_target: str | Path | None = None,
) -> dict:
    """All tasks, or without augmentation the first three."""
    root = Path(data_root)
    job = Job(spark, source, root, gates, budget_gb, Path(origin) if origin else None, target_per_task, max_new_episodes, catalog_backend, Path(catalog_target) if catalog_target else None)
    done = run_tasks(job, None if do_augment else ["acquire", "validate", "catalog_real"])
    real = done["validate"]
    if real["action"] != "ready":
        return {"source": source.id, "action": real["action"]}
    versions = [done[t]["version"] for t in ("catalog_real", "catalog_aug") if done.get(t)]
    out = {"source": source.id, "action": "ready", "versions": versions, "pass_rate": real["pass_rate"], "generated": done.get("augment", {}).get("generated", 0)}
    if do_augment:
        out["combined_pass_rate"] = done["augment"]["combined_pass_rate"]
    log_event("pipeline_done", **out)
    (root / "manifest").mkdir(exist_ok=True)
    (root / "manifest" / f"pipeline-{source.id}.json").write_text(json.dumps(out), encoding="utf-8")
    return out
