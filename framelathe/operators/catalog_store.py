"""Where catalog rows are kept: a Parquet folder, SQLite, or PostgreSQL.  All replace the row of a version."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .catalog import SCHEMA, Catalog

COLUMNS = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
_KIND = {"string": "TEXT", "bigint": "BIGINT", "double": "DOUBLE PRECISION"}
TABLE = ", ".join(f"{n} {_KIND[k]}" + (" PRIMARY KEY" if n == "dataset_version" else "") for n, k in (x.strip().split(" ") for x in SCHEMA.split(",")))


def checked(rows: DataFrame) -> list[tuple]:
    """The rows to write, a handful: one per dataset version."""
    out = [tuple(r) for r in rows.select(*COLUMNS).collect()]
    for r in out:
        if r[0] is None or r[1] is None:
            raise ValueError("dataset_version and source_id must not be null")
        if r[6] is not None:
            json.loads(r[6])
    return out


class SqliteCatalog:
    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.connect() as c:
            c.execute(f"CREATE TABLE IF NOT EXISTS dataset_version ({TABLE})")

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path)

    def read(self) -> DataFrame:
        with self.connect() as c:
            rows = c.execute(f"SELECT {', '.join(COLUMNS)} FROM dataset_version ORDER BY dataset_version").fetchall()
        return self.spark.createDataFrame(rows, SCHEMA)

    def upsert(self, rows: DataFrame) -> None:
        with self.connect() as c:
            c.executemany(f"INSERT OR REPLACE INTO dataset_version ({', '.join(COLUMNS)}) VALUES ({', '.join('?' * len(COLUMNS))})", checked(rows))


class PostgresCatalog:
    """Needs the psycopg package, which is not part of this repository's environment."""

    def __init__(self, spark: SparkSession, dsn: str):
        try:
            import psycopg
        except ImportError as e:
            raise RuntimeError("the postgres catalog needs the psycopg package") from e
        self.spark, self.dsn, self.psycopg = spark, dsn, psycopg

    def read(self) -> DataFrame:
        with self.psycopg.connect(self.dsn) as c:
            rows = c.execute(f"SELECT {', '.join(COLUMNS)} FROM dataset_version ORDER BY dataset_version").fetchall()
        return self.spark.createDataFrame([tuple(json.dumps(v) if isinstance(v, dict) else v for v in r) for r in rows], SCHEMA)

    def upsert(self, rows: DataFrame) -> None:
        sets = ", ".join(f"{c} = EXCLUDED.{c}" for c in COLUMNS[1:])
        marks = ", ".join("%s::jsonb" if c == "task_distribution" else "%s" for c in COLUMNS)
        with self.psycopg.connect(self.dsn) as c, c.cursor() as cur:
            cur.executemany(f"INSERT INTO dataset_version ({', '.join(COLUMNS)}) VALUES ({marks}) ON CONFLICT (dataset_version) DO UPDATE SET {sets}", checked(rows))


def open_catalog(spark: SparkSession, backend: str, target: str | Path):
    kinds = {"parquet": Catalog, "sqlite": SqliteCatalog, "postgres": PostgresCatalog}
    if backend not in kinds:
        raise ValueError(f"unknown catalog backend {backend!r}; known: {sorted(kinds)}")
    return kinds[backend](spark, target)
