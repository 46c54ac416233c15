"""``python -m framelathe.cli pipeline|validate|acquire|tasks|scale|report|seed``"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .config import QualityGates, Source, load_gates, load_sources
from .log import log_event
from .operators.budget import GIB, Guard
from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="framelathe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("pipeline", "validate", "acquire", "tasks"):
        s = sub.add_parser(name)
        if name == "tasks":
            s.add_argument("--only", nargs="*", help="tasks to run, in their order; all without it")
        s.add_argument("--source", required=True)
        s.add_argument("--config")
        s.add_argument("--gates")
        s.add_argument("--data-root", default="./data")
        s.add_argument("--origin", help="folder to acquire from")
        s.add_argument("--budget-gb", type=float, default=None)
        s.add_argument("--dry-run", action="store_true")
        s.add_argument("--schema-only", action="store_true")
        s.add_argument("--no-augment", action="store_true")
        s.add_argument("--target-per-task", type=int, default=3)
        s.add_argument("--max-new-episodes", type=int, default=20)
        s.add_argument("--catalog-backend", default="parquet")
        s.add_argument("--catalog-target")
    for name in ("report", "seed"):
        s = sub.add_parser(name)
        s.add_argument("--data-root", default="./data")
        s.add_argument("--catalog-backend", default="parquet")
        s.add_argument("--catalog-target")
    s = sub.add_parser("scale")
    s.add_argument("--synthetic", action="store_true")
    s.add_argument("--source")
    s.add_argument("--raw", help="folder that holds the source")
    s.add_argument("--config")
    s.add_argument("--gates")
    s.add_argument("--data-root", default="./data")
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--max-units", type=int, default=None)
    s.add_argument("--budget-gb", type=float, default=None)
    s.add_argument("--catalog-backend", default="sqlite")
    s.add_argument("--catalog-target")
    a = p.parse_args(argv)
    spark = session(master="local[*]")
    root = Path(a.data_root)
    if a.command in ("report", "seed"):
        from .operators import report
        from .operators.catalog_store import open_catalog

        versions = open_catalog(spark, a.catalog_backend, a.catalog_target or root / ("catalog.db" if a.catalog_backend == "sqlite" else "catalog"))
        rows = versions.read()
        if a.command == "seed":  # a backend makes its table when it is opened
            print(json.dumps({"versions": rows.count()}))
            return 0
        tables = {"versions": report.versions(rows), "pass_rates": report.pass_rates(rows), "totals": report.totals(rows)}
        if list((root / "manifest").glob("*.json")):
            tables["storage"] = report.storage(report.manifests(spark, str(root / "manifest")).filter("budget_bytes is not null")).drop("processed_units", "processed_episodes")
        for name, df in tables.items():
            for r in df.toJSON().collect():  # a row a version
                print(json.dumps({"table": name} | json.loads(r)))
        return 0
    budget = int(a.budget_gb * GIB) if a.budget_gb else None
    if a.command == "scale" and (a.synthetic or not a.source):
        from .streaming import run_synthetic_scale

        done = run_synthetic_scale(spark, root, seed=a.seed, max_units=a.max_units, budget_bytes=budget)
        print(json.dumps(done.as_dict()))
        if a.max_units is None:
            done.assert_invariant()
        return 0
    gates = load_gates(a.gates) if a.gates else QualityGates()
    try:
        listed = load_sources(a.config) if a.config else None
        source = listed.get(a.source) if listed else Source(a.source)
    except KeyError as e:
        print(e, file=sys.stderr)
        return 2
    if not source.enabled:
        log_event("source_disabled", source=source.id)
        return 0
    if a.command == "scale":
        from .streaming import run_folder_scale

        if not a.raw:
            p.error("scale of a source needs --raw")
        room = budget or int((listed.storage_budget_gb if listed else 25.0) * GIB)
        done = run_folder_scale(
            spark, source, a.raw, data_root=root, gates=gates, budget_bytes=room, max_units=a.max_units, catalog_backend=a.catalog_backend, catalog_target=a.catalog_target,
        )
        print(json.dumps(done.as_dict()))
        return 0
    guard = Guard(root, a.budget_gb if a.budget_gb is not None else (listed.storage_budget_gb if listed else 25.0))
    if a.command == "acquire":
        from .plans import acquire

        if not a.origin:
            p.error("acquire needs --origin")
        log_event("storage_usage", when="start", **guard.usage())
        acquire(spark, a.origin, root / "raw" / source.id, guard, dry_run=a.dry_run)
        log_event("storage_usage", when="end", **guard.usage())
        return 0
    if a.command == "validate":
        from .plans import ingest, run_validation

        if a.schema_only:
            return int(ingest(spark, source.id, root, gates)[0] != "ready")
        return int(run_validation(spark, source.id, guard, root, gates).action != "ready")
    if a.command == "tasks":
        from .plans import Job, run_tasks

        job = Job(
            spark, source, root, gates, guard.budget_gb, Path(a.origin) if a.origin else None, a.target_per_task, a.max_new_episodes, a.catalog_backend,
            Path(a.catalog_target) if a.catalog_target else None,
        )
        return int(run_tasks(job, a.only or None).get("validate", {"action": "ready"})["action"] != "ready")
    from .plans import run_pipeline

    done = run_pipeline(
        spark, source, data_root=root, gates=gates, budget_gb=guard.budget_gb, origin=a.origin, do_augment=not a.no_augment,
        target_per_task=a.target_per_task, max_new_episodes=a.max_new_episodes, catalog_backend=a.catalog_backend, catalog_target=a.catalog_target,
    )
    print(json.dumps(done))
    return int(done["action"] != "ready")


if __name__ == "__main__":
    sys.exit(main())
