"""Process and evict: any amount of raw data through a folder of bounded size.

A source lists units.  As many as the budget leaves room for are fetched into
the raw folder, where a file stream finds them: a micro-batch is what was
admitted, judged in one job.  Its outputs are made durable in the order curated,
quarantine, catalog, manifest; only then are its raw units deleted and the next
ones fetched.  Nothing is admitted beyond the budget: the source waits.

All outputs are keyed by unit and overwrite that unit alone, and the manifest
says which units are done, so a run that was stopped anywhere can be repeated.
The raw folder and the budget are the driver's: the point is a disk that is
smaller than the data.
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SignalGates
from ..log import log_event
from ..operators import catalog
from ..operators.budget import GIB, Guard, ScaleReport
from ..operators.calibrate import Calibration, calibrate
from ..operators.catalog_store import open_catalog
from ..operators.curate import SAMPLE_FRAMES, capped, samples
from ..operators.gates import signal_gates
from ..sources import from_arrays
from ..sources.dataset import Dataset, declared_dims
from .source import Unit, UnitSource

MANIFEST = (
    "unit string, bytes bigint, peak bigint, passed bigint, quarantined bigint, frames bigint, sample_bytes bigint, episodes array<bigint>, tasks map<string,bigint>"
)


def resolve_calibration(
    spark: SparkSession, raw: str | Path, store: str | Path, *, dims: tuple[int, int], names: tuple[str, ...], percentile: float = 99.9, sample_files: int = 15
) -> Calibration:
    """The first stored calibration among ``names`` that fits, else one from the first files in order, stored under the last name."""
    store = Path(store)
    for n in names:
        path = store / f"{n}.json"
        if path.exists() and (have := Calibration.load(path)).fits(sum(dims), dims[1]):
            log_event("calibration_loaded", name=n)
            return have
    files = sorted((Path(raw) / "data").rglob("*.parquet"))[:sample_files]
    if not files:
        raise ValueError(f"no data below {raw} to calibrate on")
    built = calibrate(from_arrays(spark.read.parquet(*map(str, files)), *dims), names[-1], percentile)
    built.save(store / f"{names[-1]}.json")
    log_event("calibration_built", name=names[-1], n_frames=built.n_frames, files=len(files))
    return built


def manifest(spark: SparkSession, path: str | Path) -> DataFrame:
    """A row for each unit done; empty where nothing is."""
    if not Path(path).exists():
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(str(path))


class Totals:
    """Sums over the manifest, kept while a run adds to it."""

    def __init__(self, rows: DataFrame):
        got = rows.agg(*[F.sum(c).alias(c) for c in ("bytes", "passed", "quarantined", "frames", "sample_bytes")], F.max("peak").alias("peak")).first()
        self.sums = Counter({k: got[k] or 0 for k in ("bytes", "passed", "quarantined", "frames", "sample_bytes")})
        self.peak = got["peak"] or 0
        self.units = {r[0] for r in rows.select("unit").toLocalIterator()}
        self.tasks = Counter({r[0]: r[1] for r in rows.select(F.explode("tasks").alias("t", "n")).groupBy("t").agg(F.sum("n")).collect()})

    def add(self, row) -> None:
        self.sums.update({k: row[k] for k in self.sums})
        self.peak = max(self.peak, row["peak"])
        self.units.add(row["unit"])
        self.tasks.update(row["tasks"] or {})

    def pass_rate(self) -> float | None:
        seen = self.sums["passed"] + self.sums["quarantined"]
        return round(self.sums["passed"] / seen, 4) if seen else None


class Scale:
    """One run: where things are, what is staged, and what a batch does."""

    def __init__(self, spark: SparkSession, source: UnitSource, root: Path, scale_id: str, version: str, budget: int, headroom: float, subcap: float, most: int | None):
        self.spark, self.source, self.version, self.scale_id = spark, source, version, scale_id
        self.raw, self.curated = root / "raw" / scale_id, root / "curated" / version
        self.quarantine, self.done = root / "quarantine" / version, root / "manifest" / version
        self.budget, self.room, self.subcap = budget, budget * headroom, budget * subcap
        self.guard = Guard(self.raw, budget / GIB)
        if self.raw.exists():  # of a run that was stopped: nothing there is in the manifest
            shutil.rmtree(self.raw)
        self.raw.mkdir(parents=True)
        self.totals = Totals(manifest(spark, self.done))
        self.staged: dict[str, tuple[Path, int]] = {}
        self.refused: list[tuple[str, int]] = []
        self.peak = 0
        self.tasks: DataFrame | None = None
        self.waiting = self.pending(most)
        self.next: Unit | None = next(self.waiting, None)

    def pending(self, most: int | None):
        new = 0
        for unit in self.source.units(self.spark):
            if unit.id in self.totals.units:
                continue
            if unit.est_bytes > self.room:
                self.refused.append((unit.id, unit.est_bytes))
                log_event("scale_unit_too_big", unit=unit.id, est_bytes=unit.est_bytes, budget_bytes=self.budget)
                continue
            if most is not None and new >= most:
                log_event("scale_max_units_reached", max_units=most)
                return
            new += 1
            yield unit

    def feed(self) -> dict[str, tuple[Path, int]]:
        """Fetch units as long as what is raw and the next one fit the budget; returns their folders and sizes."""
        got: dict[str, tuple[Path, int]] = {}
        while self.next is not None:
            used = self.guard.used()
            if used and used + self.next.est_bytes > self.room:
                log_event("scale_backpressure", unit=self.next.id, current_raw=used, est=self.next.est_bytes)
                break
            # a folder of its own for each attempt: a stream reads no path twice
            dest = self.raw / f"{uuid.uuid4().hex[:12]}.part"
            size = self.source.fetch(self.next, dest)
            got[self.next.id] = (dest.with_suffix(""), size)
            dest.rename(dest.with_suffix(""))
            self.peak = max(self.peak, self.guard.used())
            self.next = next(self.waiting, None)
        return got

    def batch(self, df: DataFrame, dims: tuple[int, int], calibration: Calibration, gates: SignalGates, versions, about: dict) -> None:
        units = dict(self.staged)
        if self.tasks is None:  # names of tasks are metadata: read once, kept on the driver
            found = Dataset(next(iter(units.values()))[0]).tasks(self.spark)
            self.tasks = self.spark.createDataFrame(found.collect(), found.schema).coalesce(1)
        of = {folder.name: unit for unit, (folder, _) in units.items()}
        name = F.regexp_extract(F.col("_file"), r"/([0-9a-f]{12})/data/", 1)
        named = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
        data = df.withColumn("unit", named[name]).drop("_file")
        fps = self.source.info().get("fps")
        key, columns = F.struct("unit", "episode_index"), [F.col(f"`{c}`") for c in data.columns]
        judged = signal_gates(from_arrays(data.withColumn("_key", key), *dims, ep="_key"), calibration, gates, fps)
        judged = judged.withColumns({"unit": F.col("ep.unit"), "episode_index": F.col("ep.episode_index")}).drop("ep").persist()

        def into(frame: DataFrame, path: Path) -> None:
            frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(str(path))

        try:
            on = ["unit", "episode_index"]
            into(data.join(judged.filter("passed").select(*on), on, "left_semi").select(columns), self.curated / "data")
            bad = judged.filter(~F.col("passed"))
            order = [c for c in ("frame_index", "timestamp") if c in data.columns]
            first = catalog.named(catalog.first_tasks(data.withColumn("_key", key), order, "_key"), self.tasks).select(F.col("ep").alias("_key"), "task")
            by = judged.withColumn("_key", key).join(first, "_key").groupBy("unit")
            seen = by.agg(
                F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("quarantined"), F.sum(F.when(F.col("passed"), F.col("n_frames")).otherwise(0)).alias("frames"),
                F.array_sort(F.collect_list("episode_index")).alias("episodes"), F.collect_list(F.when(F.col("passed"), F.col("task"))).alias("tasks"),
            ).collect()  # as many rows as units were admitted
            if sum(r["quarantined"] for r in seen):
                into(bad.select("unit", "episode_index", "reasons"), self.quarantine / "rejects")
                left = self.subcap - self.totals.sums["sample_bytes"]
                if left > 0:  # each failing episode while those before it stay below the cap
                    some = samples(data.withColumn("_key", key), bad.withColumn("ep", key), order, "_key", SAMPLE_FRAMES).drop("_key", "rn")
                    sizes = some.groupBy(*on).agg(F.sum(F.octet_length(F.to_json(F.struct(*columns)))).alias("size"))
                    within = capped(sizes, left, on, "size").select(*on)
                    into(some.join(within, on, "left_semi").select(columns), self.quarantine / "samples")
        finally:
            judged.unpersist()
        rows = []
        for r in seen:
            kept = self.quarantine / "samples" / f"unit={r['unit']}"
            size = sum(p.stat().st_size for p in kept.rglob("*.parquet")) if kept.exists() else 0
            rows.append((r["unit"], units[r["unit"]][1], self.peak, r["passed"], r["quarantined"], r["frames"], size, r["episodes"], dict(Counter(r["tasks"]))))
        for name in set(units) - {r[0] for r in rows}:  # without a row
            rows.append((name, units[name][1], self.peak, 0, 0, 0, 0, [], {}))
        fields = [x.strip().split(" ")[0] for x in MANIFEST.split(",", 7)[:7]] + ["episodes", "tasks"]
        for row in rows:
            self.totals.add(dict(zip(fields, row)))
        self.write_meta(next(iter(units.values()))[0])
        versions.upsert(self.record(about))
        into(self.spark.createDataFrame(rows, MANIFEST).coalesce(1), self.done)
        for name, (folder, _) in units.items():
            log_event("scale_unit_done", unit=name, freed_bytes=self.guard.evict(folder), raw_now=self.guard.used())

    def write_meta(self, batch: Path) -> None:
        meta = self.curated / "meta"
        meta.mkdir(parents=True, exist_ok=True)
        for name in ("tasks.parquet", "tasks.jsonl", "stats.json"):
            if (batch / "meta" / name).exists() and not (meta / name).exists():
                shutil.copy2(batch / "meta" / name, meta / name)
        info = self.source.info() | {"total_episodes": self.totals.sums["passed"], "total_frames": self.totals.sums["frames"]}
        (meta / "info.json").write_text(json.dumps(info, indent=2), encoding="utf-8")

    def record(self, about: dict) -> DataFrame:
        """The catalog row of what is curated so far, from the totals: no data are read again."""
        s = self.totals.sums
        seen = s["passed"] + s["quarantined"]
        row = {
            "dataset_version": self.version, "source_id": self.scale_id, "episode_count": s["passed"], "frame_count": s["frames"],
            "task_distribution": json.dumps(dict(sorted(self.totals.tasks.items()))), "gate_pass_rate": self.totals.pass_rate(), "bytes_on_disk": 0,
            "created_at": datetime.now(timezone.utc).isoformat(), "notes": f"scale run; {s['passed']}/{seen} episodes passed",
        } | about
        kinds = [x.strip().split(" ")[0] for x in catalog.SCHEMA.split(",")]
        return self.spark.createDataFrame([tuple(row.get(k) for k in kinds)], catalog.SCHEMA)


def run_scale(
    spark: SparkSession, source: UnitSource, *, data_root: str | Path, budget_bytes: int, calibration: Calibration, scale_id: str = "scale", dataset_version: str = "v0.1.0-scale",
    gates: SignalGates = SignalGates(), headroom: float = 0.9, subcap_frac: float = 0.05, max_units: int | None = None, catalog_backend: str = "sqlite",
    catalog_target: str | Path | None = None, hf_repo: str | None = None, license: str | None = None,
) -> ScaleReport:
    """Gate and curate every unit of a source with at most ``budget_bytes`` of raw data on disk; resumable.

    Units larger than the budget times ``headroom`` are refused and listed under
    ``refused_units`` beside the manifest.  ``max_units`` bounds the new units of this run.
    """
    root, dims = Path(data_root), declared_dims(source.info())
    if not calibration.fits(sum(dims), dims[1]):
        raise ValueError(f"calibration does not fit signals of {dims}")
    run = Scale(spark, source, root, scale_id, dataset_version, budget_bytes, headroom, subcap_frac, max_units)
    versions = open_catalog(spark, catalog_backend, catalog_target or root / ("catalog.db" if catalog_backend == "sqlite" else "catalog"))
    log_event("scale_start", scale_id=scale_id, dataset_version=dataset_version, budget_bytes=budget_bytes, resuming_units=len(run.totals.units))
    run.staged = run.feed()
    if run.staged:
        first = next(p for folder, _ in run.staged.values() for p in sorted((folder / "data").rglob("*.parquet")))
        schema = spark.read.parquet(str(first)).schema
        frames = (
            spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreMissingFiles", "true")
            .parquet(f"{run.raw}/*/data").select("*", F.col("_metadata.file_path").alias("_file"))
        )
        about = {"hf_repo": hf_repo, "license": license}
        log = root / "checkpoint" / f"{dataset_version}-{uuid.uuid4().hex[:12]}"

        def batch(df: DataFrame, _: int) -> None:  # nothing is listed while this runs, so no half-fetched unit is taken
            if run.staged:
                run.batch(df, dims, calibration, gates, versions, about)
                run.staged = run.feed()

        query = frames.writeStream.foreachBatch(batch).option("checkpointLocation", str(log)).start()
        try:
            while run.staged and not query.awaitTermination(0.2):  # raises what a batch raised
                pass
        finally:
            query.stop()
            shutil.rmtree(log, ignore_errors=True)
    if run.refused:
        spark.createDataFrame(run.refused, "unit string, bytes bigint").coalesce(1).write.mode("overwrite").parquet(str(root / "refused_units" / dataset_version))
    done = report(spark, run.done, budget_bytes)
    said = {"dataset_version": dataset_version, "processed_units": sorted(run.totals.units)} | {
        k: v for k, v in done.as_dict().items() if k in ("budget_bytes", "total_processed_bytes", "peak_raw_bytes", "episodes_passed", "episodes_quarantined")
    }
    run.done.parent.mkdir(parents=True, exist_ok=True)
    (run.done.parent / f"{dataset_version}.json").write_text(json.dumps(said), encoding="utf-8")
    log_event("scale_done", **done.as_dict())
    return done


def report(spark: SparkSession, path: Path, budget_bytes: int) -> ScaleReport:
    """Counters from the manifest; an episode split over units counts once in the total."""
    rows = manifest(spark, path)
    got = rows.agg(F.max("peak"), F.sum("bytes"), F.count(F.lit(1)), F.sum("passed"), F.sum("quarantined")).first()
    episodes = rows.select(F.explode("episodes").alias("e")).agg(F.countDistinct("e")).first()[0]
    return ScaleReport(budget_bytes, got[0] or 0, got[1] or 0, got[2], episodes, got[3] or 0, got[4] or 0)
