"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the budget divided by its size.  Every
document draws a count from a Poisson distribution with that mean, by inverting
the distribution at a uniform number hashed from the seed and the doc_id; the
document is repeated so often and all copies are shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
#: Above this mean a rate is split into equal parts that are drawn one by one.
MAX_MEAN = 200.0
#: Rates are broadcast while they are fewer than this; else they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def uniform(*parts) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def cdf(mean: Column) -> Column:
    """Cumulative Poisson probabilities from 0 on, far enough that the rest is below 1e-15."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    term = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        term,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c"),
        ),
        lambda a: a["c"],
    )


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.5, budget: float | None = None) -> DataFrame:
    """``source, size, rate``: size in characters of text, rate the mean number of copies.

    Weights default to ``size ** alpha`` (0: equal shares, 1: as it is); a source
    that ``weights`` does not name gets none.  The budget defaults to the size of
    all sources.  A null source is a source of its own; one without text has rate 0.
    """
    sizes = docs.groupBy("source").agg(
        F.sum(F.coalesce(F.length(F.col("text")), F.lit(0)).cast("long")).cast("double").alias("size")
    )
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow("size", F.lit(float(alpha)))).otherwise(0.0)
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0))
    sizes = sizes.withColumn("raw", raw)
    total = sizes.agg(F.sum("raw").alias("_raw"), F.sum("size").alias("_size"))
    goal = F.lit(float(budget)) if budget is not None else F.col("_size")
    rate = F.when((F.col("size") > 0) & (F.col("_raw") > 0), F.col("raw") / F.col("_raw") * goal / F.col("size")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(total)).select("source", "size", rate.alias("rate"))  # one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.5, budget: float | None = None, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, each document as often as drawn.

    Rows of one doc_id draw alike; rows with a null doc_id draw by a hash of their
    text, so however many there are they land apart.  Empty table: empty.  Rows land in hash partitions of ``shuffle_key`` and are sorted by it there.
    Columns of ``docs`` named ``copy`` or ``shuffle_key`` are replaced.
    """
    by = rates(docs, weights, alpha=alpha, budget=budget)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")
    by = by.filter("rate > 0").select(
        F.col("source").alias("_source"), parts.alias("_parts"), cdf(F.col("rate") / parts).alias("_cdf")
    )
    spark = docs.sparkSession
    found = by.take(BROADCAST_SOURCES + 1)
    if len(found) <= BROADCAST_SOURCES:  # bounded: so many rows of some dozens to hundreds of numbers
        by = F.broadcast(spark.createDataFrame(found, by.schema))
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    name = F.coalesce(F.col("doc_id").cast("string"), unnamed)
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda k: F.size(F.filter("_cdf", lambda c: c < uniform(F.lit(seed), name, k.cast("string")))),
    )
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key", "_source", "_parts", "_cdf")]
    drawn = (
        docs.join(by, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_n", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
        .filter("_n > 0")
    )
    copies = drawn.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("copy"))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), name, F.col("copy").cast("string"), F.lit("order")).cast("binary")))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))


_NAME = "coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))"
ORACLE = f"""
WITH RECURSIVE s AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), r AS (
  SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s WHERE size > 0
), c AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM c WHERE k < rate + 12 * sqrt(rate) + 30
), d AS (
  SELECT *, (('0x' || substr(md5('{SEED}:' || {_NAME} || ':1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    row_number() OVER () AS row FROM documents
), n AS (
  SELECT row, count(*) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cum < d.u GROUP BY row
)
SELECT doc_id, text, lang, source, n_chars, copy,
  md5('{SEED}:' || {_NAME} || ':' || copy || ':order') AS shuffle_key
FROM (SELECT d.*, unnest(range(1, n + 1)) AS copy FROM d JOIN n USING (row))
"""
