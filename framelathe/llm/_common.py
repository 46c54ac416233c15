"""Helpers shared by the operators: shared folder, cut lineage, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="framelathe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_written: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/framelathe/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def tables() -> set[str]:
    """Paths of the tables that operators of this process wrote to the shared folder and that are still there."""
    return set(_written)


def sweep(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete those tables but the ones to keep; results that read them must be stored by now."""
    for path in tables() - keep:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def observed(seen: Observation, wait: float = 60.0) -> int | None:
    """The count ``n`` that a job observed; None if a busy session doesn't deliver it in so many seconds, as it may."""
    got: list[int] = []
    asks = threading.Thread(target=lambda: got.append(seen.get.get("n", 0)), daemon=True)
    asks.start()
    asks.join(wait)
    return got[0] if got else None


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, lost executors cost nothing.

    Raises if the driver reads other than was written, as it would from a folder that isn't shared.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    wrote = observed(seen)
    if wrote is not None and (found := back.count()) != wrote:
        raise RuntimeError(f"{path}: {wrote} rows written, {found} read back; is the folder shared?")
    return back


def hex64(col: Column) -> Column:
    """16 lower-case hex digits of an unsigned 64-bit value held in a long."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def balanced(df: DataFrame, small: int = 64 << 20) -> DataFrame:
    """A small input, which may be one row group and so one task, dealt to all cores; larger ones as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < small and cores > 1 else df


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column: what partition counts are sized from."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(column)).cast("long"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, no nulls) by alternating star contraction.

    Returns ``node, component``, the component being its smallest node.  Each
    round is two joins of the links with their per-node minima and ends in a
    written table; links only shrink towards stars, so a round never grows the
    data.  Stops when no link changes, and not before.  No links: an empty table.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            sym = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = sym.join(low, "u")
        out = hung.filter(F.col("v") > F.col("u")) if large else hung
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(low.select("u", F.col("m").alias("v")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def written(e: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = new_path(spark, "stars")
        e.write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return path, e, tuple(mark)

    path, now, mark = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    while mark[0]:
        new_at, new, new_mark = written(star(star(now, True), False))
        remove(spark, path)
        path, now = new_at, new
        if new_mark == mark:
            break
        mark = new_mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
