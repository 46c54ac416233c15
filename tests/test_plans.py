import json

import pytest
from pyspark.sql import functions as F

from framelathe.config import QualityGates, SchemaGates, Source, load_gates, load_sources
from framelathe.operators import augment, catalog
from framelathe.operators.budget import BudgetExceeded, Guard, running_sum
from framelathe.operators.schema_gate import validate
from framelathe.plans import acquire, ingest, run_pipeline, run_validation
from framelathe.sources import Dataset, list_files
from framelathe.operators.catalog_store import open_catalog
from framelathe.streaming import FolderSource, run_scale, run_synthetic_scale, synthetic_store, unit_calibration
from framelathe.streaming.evict import manifest

GATES = QualityGates(schema=SchemaGates(required_features=("observation.state", "action"), image_keys_any_of=("cam1",)))


@pytest.fixture()
def made(spark, tmp_path):
    """A dataset of 9 episodes in nested chunks, the first and the eighth bad, with names for two of four tasks."""
    root = tmp_path / "origin"
    synthetic_store(spark, root, chunks=3, eps_per_chunk=3, frames=200)
    info = json.loads((root / "meta" / "info.json").read_text())
    info["features"]["cam1"] = {"dtype": "video", "shape": [3, 8, 8]}
    (root / "meta" / "info.json").write_text(json.dumps(info))
    (root / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "push"}\n{"task_index": 1, "task": "pull"}\n')
    return root


def test_nested_layout_is_read_whole(spark, made):
    d = Dataset(made)
    assert d.data(spark).count() == 9 * 200 and d.dims() == (7, 7)
    assert list_files(spark, str(made / "data")).agg(F.sum("size")).first()[0] == sum(f.stat().st_size for f in d.files())
    assert {r.task for r in d.tasks(spark).collect()} == {"push", "pull"}
    assert "frame_index" in d.data_columns(spark)


def test_task_names(spark, tmp_path):
    from framelathe.sources.dataset import task_names

    assert task_names(spark.createDataFrame([(1, "a")], "task_index int, __index_level_0__ string")).collect() == [(1, "a")]
    assert task_names(spark.createDataFrame([(1, "x")], "task_index int, other string")).collect() == [(1, "x")]
    assert task_names(spark.createDataFrame([(4,)], "task_index int")).collect() == [(4, "task_4")]
    assert Dataset(tmp_path).tasks(spark).count() == 0


def test_schema_gate(spark, made):
    d = Dataset(made)
    assert validate(spark, d, GATES).passed
    info = d.info()
    info["features"].pop("action")
    info["features"].pop("cam1")
    (made / "meta" / "tasks.jsonl").unlink()
    (made / "meta" / "info.json").write_text(json.dumps(info))
    said = validate(spark, d, GATES).reasons
    assert said[0] == "missing required feature 'action'" and said[1].startswith("no image feature") and said[2].startswith("no resolvable language")
    assert len(said) == 3


def test_policies(spark, made, tmp_path):
    bad = QualityGates(schema=SchemaGates(required_features=("gripper",), image_keys_any_of=("cam1",)))
    guard = Guard(tmp_path / "d", 1)
    acquire(spark, made, tmp_path / "d" / "raw" / "s", guard)
    assert ingest(spark, "s", tmp_path / "d", bad)[0] == "quarantined"
    assert (tmp_path / "d" / "quarantine" / "s" / "_rejects.json").exists()
    assert ingest(spark, "s", tmp_path / "d", bad)[0] == "error"
    acquire(spark, made, tmp_path / "d" / "raw" / "s", guard)
    assert ingest(spark, "s", tmp_path / "d", QualityGates(schema=bad.schema, on_fail="drop"))[0] == "dropped"
    (tmp_path / "d" / "raw" / "x").mkdir(parents=True)
    with pytest.raises(NotImplementedError):
        ingest(spark, "x", tmp_path / "d", bad)
    with pytest.raises(ValueError):
        QualityGates(on_fail="shrug")


def test_validation_and_pipeline(spark, made, tmp_path):
    root = tmp_path / "data"
    done = run_pipeline(spark, Source("s"), data_root=root, gates=GATES, budget_gb=1, origin=made, target_per_task=4, max_new_episodes=5)
    assert done["action"] == "ready" and done["generated"] >= 1
    rows = {r.dataset_version: r for r in catalog.Catalog(spark, root / "catalog").read().collect()}
    v1, v2 = rows["v0.1.0-s"], rows["v0.2.0-s-aug"]
    assert v1.episode_count < 9 + 1 and v2.episode_count > v1.episode_count
    assert "task_3" in json.loads(v1.task_distribution) and "push" in json.loads(v1.task_distribution)
    assert not (root / "raw" / "s").exists()
    assert Dataset(root / "curated" / "s").info()["total_episodes"] == v1.episode_count
    again = catalog.Catalog(spark, root / "catalog")
    again.upsert(again.read().filter("dataset_version = 'v0.1.0-s'").withColumn("notes", F.lit("new")))
    assert {r.dataset_version: r.notes for r in again.read().collect()}["v0.1.0-s"] == "new" and again.read().count() == 2
    with pytest.raises(ValueError):
        again.upsert(again.read().withColumn("source_id", F.lit(None).cast("string")))


def test_acquisition_stops_at_the_budget(spark, made, tmp_path):
    sizes = {str(p.relative_to(made)): p.stat().st_size for p in made.rglob("*") if p.is_file()}
    meta = sum(v for k, v in sizes.items() if k.startswith("meta/"))
    data = sorted(k for k in sizes if k.startswith("data/"))
    guard = Guard(tmp_path / "d", (meta + sizes[data[0]]) / 1024**3)
    dry = acquire(spark, made, tmp_path / "d" / "raw", guard, dry_run=True)
    real = acquire(spark, made, tmp_path / "d" / "raw", guard)
    assert dry == real and real.stopped_at == data[1] and real.bytes == meta + sizes[data[0]]


def test_guard(tmp_path):
    g = Guard(tmp_path, 100 / 1024**3)
    (tmp_path / "a").write_bytes(b"x" * 60)
    assert g.can_admit(40) and not g.can_admit(41) and g.can_admit(-5)
    with pytest.raises(BudgetExceeded):
        g.admit(41, "b")
    assert g.evict(tmp_path / "a") == 60 and g.used() == 0 and g.evict(tmp_path / "a") == 0
    assert g.usage()["pct"] == 0.0


def test_running_sum_over_ranges(spark):
    df = spark.createDataFrame([(f"k{i % 50:02d}", i) for i in range(300)], "k string, v bigint")
    got = sorted((r.k, r.v, r.t) for r in running_sum(df, ["k", "v"], F.col("v"), "t", ranges=7).collect())
    total, want = 0, []
    for k, v in sorted((r.k, r.v) for r in df.collect()):
        total += v
        want.append((k, v, total))
    assert got == want
    assert running_sum(df.filter("v < 0"), ["k", "v"], F.col("v"), "t").count() == 0


def stored(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_scale_invariant_holds(spark, tmp_path):
    """The seeded run: 24 episodes, 20 of them good, with four times the budget through a raw folder that keeps it."""
    done = run_synthetic_scale(spark, tmp_path, frames=1200)
    assert (done.episodes_total, done.episodes_passed, done.episodes_quarantined, done.units_processed) == (24, 20, 4, 8)
    assert done.peak_raw_bytes < done.budget_bytes < done.total_processed_bytes and done.invariant_holds
    assert 3.9 < done.as_dict()["throughput_x_budget"] < 4.5 and 0.4 < done.as_dict()["headroom_ratio"] < 0.6
    done.assert_invariant()
    assert not list((tmp_path / "raw" / "synthetic").iterdir())
    curated = Dataset(tmp_path / "curated" / "v0.0.0-synthetic-scale")
    assert curated.data(spark).count() == 20 * 1200 and curated.info()["total_episodes"] == 20 and curated.info()["total_frames"] == 24000
    assert {r.task for r in curated.tasks(spark).collect()} == {"a", "b", "c", "d"}
    row = open_catalog(spark, "sqlite", tmp_path / "catalog.db").read().first()
    assert row.episode_count == 20 and row.frame_count == 24000 and row.gate_pass_rate == round(20 / 24, 4) and row.notes.endswith("20/24 episodes passed")
    assert sum(json.loads(row.task_distribution).values()) == 20
    quarantine = tmp_path / "quarantine" / "v0.0.0-synthetic-scale"
    assert sorted(r.episode_index for r in spark.read.parquet(str(quarantine / "rejects")).collect()) == [0, 7, 14, 21]
    assert stored(quarantine / "samples") < done.budget_bytes * 0.5


def test_process_and_evict(spark, tmp_path):
    store, root = tmp_path / "store", tmp_path / "d"
    synthetic_store(spark, store, chunks=6, frames=200)
    total = stored(store / "data")
    source = FolderSource(store, by="chunk")
    how = dict(data_root=root, calibration=unit_calibration(), budget_bytes=total * 2 // 5, dataset_version="v", subcap_frac=0.5)
    first = run_scale(spark, source, **how, max_units=2)
    assert first.units_processed == 2 and len(list((store / "data").rglob("*.parquet"))) == 6
    done = run_scale(spark, source, **how)
    assert done.units_processed == 6 and done.invariant_holds
    assert done.episodes_total == 18 and done.episodes_quarantined == 3 and done.episodes_passed == 15
    assert total <= done.total_processed_bytes < total * 1.5
    assert Dataset(root / "curated" / "v").data(spark).count() == 15 * 200
    kept = spark.read.parquet(str(root / "quarantine" / "v" / "samples")).groupBy("episode_index").count().collect()
    assert sorted((r.episode_index, r["count"]) for r in kept) == [(0, 5), (7, 5), (14, 5)]
    assert run_scale(spark, source, **how) == done
    assert manifest(spark, root / "manifest" / "v").count() == 6
    said = json.loads((root / "manifest" / "v.json").read_text())
    assert said["processed_units"] == [f"00{k}" for k in range(6)] and said["budget_bytes"] == total * 2 // 5


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    """A run that dies before the manifest is written is repeated for that unit, without traces of the first attempt."""
    from framelathe.streaming import evict

    store, root = tmp_path / "store", tmp_path / "d"
    synthetic_store(spark, store, chunks=3, frames=100)
    how = dict(data_root=root, calibration=unit_calibration(), budget_bytes=stored(store / "data") // 2, dataset_version="v")
    real = evict.Scale.record

    def dies(self, about):
        if self.totals.units >= {"001"}:
            raise OSError("the catalog is gone")
        return real(self, about)

    monkeypatch.setattr(evict.Scale, "record", dies)
    with pytest.raises(Exception, match="catalog is gone"):
        run_scale(spark, FolderSource(store, by="chunk"), **how)
    assert [r.unit for r in manifest(spark, root / "manifest" / "v").collect()] == ["000"] and list((root / "raw" / "scale").iterdir())
    monkeypatch.setattr(evict.Scale, "record", real)
    done = run_scale(spark, FolderSource(store, by="chunk"), **how)
    assert done.units_processed == 3 and done.episodes_total == 9 and done.episodes_quarantined == 2 and done.invariant_holds
    assert Dataset(root / "curated" / "v").data(spark).count() == 7 * 100


def test_unit_too_big_is_refused_and_listed(spark, tmp_path):
    store, root = tmp_path / "store", tmp_path / "out"
    synthetic_store(spark, store, chunks=2, frames=60)
    source = FolderSource(store, by="chunk")
    r = run_scale(spark, source, data_root=root, calibration=unit_calibration(), budget_bytes=10)
    assert r.units_processed == 0 and spark.read.parquet(str(root / "refused_units" / "v0.1.0-scale")).count() == 2
    with pytest.raises(ValueError):
        run_scale(spark, source, data_root=root, calibration=unit_calibration(16, 8), budget_bytes=10)
    with pytest.raises(AssertionError):
        r.assert_invariant()


def test_samples_stay_below_their_cap(spark, tmp_path):
    """Episode by episode: the first that finds the cap reached is left out, also within one unit."""
    store, root = tmp_path / "store", tmp_path / "d"
    synthetic_store(spark, store, chunks=1, eps_per_chunk=6, frames=60, bad_every=1)
    budget = stored(store) * 3
    some = spark.read.parquet(str(store / "data" / "chunk-000")).limit(5).selectExpr("octet_length(to_json(struct(*))) AS n").agg(F.sum("n")).first()[0]
    done = run_scale(spark, FolderSource(store, by="chunk"), data_root=root, calibration=unit_calibration(), budget_bytes=budget, subcap_frac=2.5 * some / budget, dataset_version="v")
    assert done.episodes_quarantined == 6
    kept = spark.read.parquet(str(root / "quarantine" / "v" / "samples")).select("episode_index").distinct().collect()
    assert sorted(r[0] for r in kept) == [0, 1, 2]


def test_units_of_files_and_videos(spark, tmp_path):
    synthetic_store(spark, tmp_path, chunks=3, frames=60)
    info = json.loads((tmp_path / "meta" / "info.json").read_text())
    info["video_path"] = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
    (tmp_path / "meta" / "info.json").write_text(json.dumps(info))
    video = tmp_path / "videos" / "observation.images.cam" / "chunk-001" / "file-000.mp4"
    video.parent.mkdir(parents=True)
    video.write_bytes(b"x" * 1000)
    source = FolderSource(tmp_path)
    units = list(source.units(spark))
    assert [u.id for u in units] == ["000-000", "001-000", "002-000"]
    size = (tmp_path / "data" / "chunk-001" / "file-000.parquet").stat().st_size
    assert units[1].est_bytes == size + 1000
    got = source.fetch(units[1], tmp_path / "to")
    assert got >= size + 1000 and (tmp_path / "to" / video.relative_to(tmp_path)).exists() and (tmp_path / "to" / "meta" / "tasks.jsonl").exists()
    assert source.fetch(units[0], tmp_path / "to0") < got  # its video is not there


def test_generated_episodes_pass_their_gates(spark):
    from framelathe.operators.gates import signal_gates
    from framelathe.sources import from_arrays

    plan = spark.createDataFrame([(i, "t", 0) for i in range(4)], "episode_index bigint, task string, task_index bigint")
    rows = augment.generate(plan, unit_calibration(), 7, 7)
    judged = signal_gates(from_arrays(rows, 7, 7), unit_calibration(), fps=15).collect()
    assert len(judged) == 4 and all(r.passed for r in judged) and all(120 <= r.n_frames < 260 for r in judged)


def test_config(tmp_path):
    (tmp_path / "s.yaml").write_text("storage_budget_gb: 2\nsources:\n  - {id: a, enabled: false}\n  - {id: b}\n")
    s = load_sources(tmp_path / "s.yaml")
    assert [x.id for x in s.enabled()] == ["b"] and s.get("a").role == "dev"
    with pytest.raises(KeyError, match="known"):
        s.get("c")
    (tmp_path / "g.yaml").write_text("schema: {required_features: [action]}\nsignal: {anomaly_percentile: 99}\npolicy: {on_fail: drop}\n")
    g = load_gates(tmp_path / "g.yaml")
    assert g.schema.required_features == ("action",) and g.signal.anomaly_percentile == 99.0 and g.on_fail == "drop"


def test_cli(spark, made, tmp_path, capsys):
    from framelathe.cli import main

    (tmp_path / "s.yaml").write_text("sources:\n  - {id: s}\n")
    (tmp_path / "g.yaml").write_text("schema: {required_features: [action], image_keys_any_of: [cam1]}\n")
    base = ["--config", str(tmp_path / "s.yaml"), "--gates", str(tmp_path / "g.yaml"), "--data-root", str(tmp_path / "d"), "--budget-gb", "1"]
    assert main(["acquire", "--source", "zzz", *base]) == 2
    assert main(["acquire", "--source", "s", "--origin", str(made), *base]) == 0
    assert main(["validate", "--source", "s", "--schema-only", *base]) == 0
    assert main(["validate", "--source", "s", *base]) == 0
    assert main(["validate", "--source", "s", *base]) == 1
    (tmp_path / "off.yaml").write_text("sources:\n  - {id: s, enabled: false}\n")
    capsys.readouterr()
    assert main(["acquire", "--source", "s", "--origin", str(made), "--config", str(tmp_path / "off.yaml"), "--data-root", str(tmp_path / "off")]) == 0
    assert "source_disabled" in capsys.readouterr().out and not (tmp_path / "off").exists()


def test_cli_scale(spark, made, tmp_path, capsys):
    from framelathe.cli import main

    assert main(["scale", "--synthetic", "--data-root", str(tmp_path / "d")]) == 0
    done = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert done["invariant_holds"] and (done["episodes_total"], done["episodes_passed"], done["episodes_quarantined"]) == (24, 20, 4)
    assert main(["scale", "--source", "s", "--raw", str(made), "--data-root", str(tmp_path / "r"), "--budget-gb", str(stored(made) * 0.6 / 1024**3), "--max-units", "2"]) == 0
    done = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert done["units_processed"] == 2 and done["episodes_total"] == 6 and (tmp_path / "r" / "calibration" / "s.json").exists()
    with pytest.raises(SystemExit):
        main(["scale", "--source", "s", "--data-root", str(tmp_path / "r")])


def test_cli_pipeline(spark, made, tmp_path, capsys):
    from framelathe.cli import main

    (tmp_path / "g.yaml").write_text("schema: {required_features: [action], image_keys_any_of: [cam1]}\n")
    assert main(["pipeline", "--source", "s", "--origin", str(made), "--gates", str(tmp_path / "g.yaml"), "--data-root", str(tmp_path / "d"), "--budget-gb", "1", "--no-augment"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["action"] == "ready"


def test_validation_stops_where_nothing_was_acquired(spark, tmp_path):
    assert run_validation(spark, "none", Guard(tmp_path, 1), tmp_path, GATES).action == "error"


def test_tasks_run_one_by_one(spark, made, tmp_path, capsys):
    from framelathe.cli import main

    (tmp_path / "g.yaml").write_text("schema: {required_features: [action], image_keys_any_of: [cam1]}\n")
    base = ["tasks", "--source", "s", "--gates", str(tmp_path / "g.yaml"), "--data-root", str(tmp_path / "d"), "--budget-gb", "1", "--origin", str(made)]
    unit_calibration().save(tmp_path / "d" / "calibration" / "s.json")
    assert main([*base, "--only", "acquire", "validate"]) == 0
    assert main([*base, "--only", "catalog_real"]) == 0
    rows = catalog.Catalog(spark, tmp_path / "d" / "catalog").read().collect()
    assert [(r.dataset_version, r.gate_pass_rate) for r in rows] == [("v0.1.0-s", round(7 / 9, 4))]
    assert main([*base, "--only", "augment", "catalog_aug"]) == 0
    assert main([*base, "--only", "augment", "catalog_aug"]) == 0  # again by itself
    rows = {r.dataset_version: r for r in catalog.Catalog(spark, tmp_path / "d" / "catalog").read().collect()}
    assert set(rows) == {"v0.1.0-s", "v0.2.0-s-aug"} and rows["v0.2.0-s-aug"].episode_count >= rows["v0.1.0-s"].episode_count == 7
    capsys.readouterr()
    assert main(["report", "--data-root", str(tmp_path / "d")]) == 0
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["dataset_version"] for r in said if r["table"] == "versions"] == ["v0.1.0-s", "v0.2.0-s-aug"]
    assert main(["seed", "--data-root", str(tmp_path / "d"), "--catalog-backend", "sqlite"]) == 0 and (tmp_path / "d" / "catalog.db").exists()


def test_postgres_statements(spark, monkeypatch):
    """What is sent, to a stand-in for the driver package."""
    import sys
    import types

    from framelathe.operators.catalog_store import COLUMNS

    sent = []

    class Stub:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            sent.append("done")

        def cursor(self):
            return self

        def executemany(self, sql, rows):
            sent.append((sql, rows))

        def execute(self, sql):
            return types.SimpleNamespace(fetchall=lambda: [("v1", "s", None, None, 2, 3, {"a": 2}, 0.5, 0, None, "now", None)])

    monkeypatch.setitem(sys.modules, "psycopg", types.SimpleNamespace(connect=lambda dsn: Stub()))
    c = open_catalog(spark, "postgres", "dsn")
    row = c.read()
    assert row.first().task_distribution == '{"a": 2}' and row.first().episode_count == 2
    c.upsert(row)
    sql, rows = next(x for x in sent if isinstance(x, tuple))
    assert sql.count("%s") == len(COLUMNS) == len(rows[0]) and "%s::jsonb" in sql and "ON CONFLICT (dataset_version) DO UPDATE SET source_id = EXCLUDED.source_id" in sql
    assert "dataset_version = EXCLUDED" not in sql


def test_last_name_counts(spark):
    names = spark.createDataFrame([(1, "z"), (1, "a"), (2, "b"), (3, "b")], "task_index bigint, task string").coalesce(1)
    got = catalog.named(spark.createDataFrame([(10, 1), (11, 4)], "ep bigint, task_index bigint"), names).collect()
    assert sorted(map(tuple, got)) == [(10, "a"), (11, "task_4")]
    plan = augment.plan(spark.createDataFrame([("b", 1)], "task string, episodes bigint"), names, target=3, cap=5).collect()
    assert [tuple(r) for r in plan] == [(0, "b", 3), (1, "b", 3)]


def test_lists_of_another_width_raise(spark):
    from framelathe.sources import from_arrays

    rows = [([1.0, 2.0], [1.0], 0.0, 0), (None, [1.0], 1.0, 0), ([1.0], [1.0], 2.0, 0)]
    df = spark.createDataFrame(rows, "`observation.state` array<double>, action array<double>, timestamp double, episode_index bigint")
    assert from_arrays(df.filter("timestamp < 2"), 2, 1).df.select("s0", "s1").collect()[0] == (1.0, 2.0)
    with pytest.raises(Exception, match="1 values, 2 declared"):
        from_arrays(df, 2, 1).df.collect()


def test_episodes_are_numbered_past_the_first(spark, tmp_path):
    """A base of episode 0 alone: new ones start at 1."""
    from framelathe.plans.pipeline import synthesise

    synthetic_store(spark, tmp_path / "s", chunks=1, eps_per_chunk=1, frames=60)
    assert synthesise(spark, Dataset(tmp_path / "s"), tmp_path / "out", unit_calibration(), target=3, cap=9) == 2
    assert {r[0] for r in Dataset(tmp_path / "out").data(spark).select("episode_index").distinct().collect()} == {1, 2}


def test_catalog_backends(spark, tmp_path):
    from framelathe.operators.catalog_store import open_catalog

    row = catalog.record(
        spark.createDataFrame([(1,), (1,), (2,)], "episode_index bigint"), spark.createDataFrame([("b", 2), ("a", 1)], "task string, episodes bigint"),
        version="v1", source="s", pass_rate=0.5, notes="first",
    )
    for backend in ("parquet", "sqlite"):
        c = open_catalog(spark, backend, tmp_path / backend)
        assert c.read().count() == 0
        c.upsert(row)
        c.upsert(row.withColumn("notes", F.lit("second")))
        c.upsert(row.withColumn("dataset_version", F.lit("v0")))
        got = c.read().orderBy("dataset_version").collect()
        assert [(r.dataset_version, r.notes) for r in got] == [("v0", "first"), ("v1", "second")]
        assert got[1].episode_count == 2 and got[1].frame_count == 3 and got[1].task_distribution == '{"a":1,"b":2}'
        with pytest.raises(ValueError):
            c.upsert(row.withColumn("source_id", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        open_catalog(spark, "mongo", tmp_path)
    with pytest.raises(RuntimeError):
        open_catalog(spark, "postgres", "x")


def test_calibration_is_resolved(spark, tmp_path):
    from framelathe.streaming import resolve_calibration

    synthetic_store(spark, tmp_path / "raw", chunks=2, frames=100)
    how = dict(dims=(7, 7), names=("dev", "own"))
    first = resolve_calibration(spark, tmp_path / "raw", tmp_path / "c", **how, sample_files=1)
    assert first.n_frames == 300 and (tmp_path / "c" / "own.json").exists()
    assert resolve_calibration(spark, tmp_path / "none", tmp_path / "c", **how) == first
    unit_calibration(9, 2).save(tmp_path / "c" / "dev.json")
    assert resolve_calibration(spark, tmp_path / "none", tmp_path / "c", **how) == first
    with pytest.raises(ValueError):
        resolve_calibration(spark, tmp_path / "none", tmp_path / "d", **how)


def test_manifest_documents_and_gates_of_a_folder(spark, made, tmp_path):
    from framelathe.config import SignalGates, load_env
    from framelathe.operators.report import manifests
    from framelathe.plans import run_signal_gates

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps({"dataset_version": "v", "budget_bytes": 5, "processed_units": ["000-001"]}))
    (tmp_path / "m" / "b.json").write_text("{broken")
    assert [(r.dataset_version, r.budget_bytes) for r in manifests(spark, str(tmp_path / "m")).collect()] == [("v", 5)]
    rows = run_signal_gates(spark, made, SignalGates(), unit_calibration()).collect()
    assert [r.ep for r in rows] == list(range(9)) and [r.ep for r in rows if not r.passed] == [0, 7]
    (tmp_path / ".env").write_text("# no\nFRAMELATHE_X='1'\nPATH=other\n")
    assert load_env(tmp_path / ".env") == {"FRAMELATHE_X": "1"}
