"""Stand-ins: frames, tasks and file listings made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nan_if_null
from ..sources.frames import Frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    return F.col(c).cast("timestamp").cast("double")


FL_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "s1", "s0", "a0", "a1")


def line_frames(spark: SparkSession, sf_dir: str) -> Frames:
    """A supplier's line items in order of shipping: quantity and price are state, discount and tax action."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ep"), "l_shipdate", "l_orderkey", "l_linenumber",
        *[nan_if_null(F.col(c)).alias(a) for c, a in (("l_quantity", "s0"), ("l_extendedprice", "s1"), ("l_discount", "a0"), ("l_tax", "a1"))],
        seconds("l_shipdate").alias("ts"),
    )
    return Frames(df, "ep", FL_ORDER, ("s0", "s1"), ("a0", "a1"), "ts")


def _jerk(x: str) -> str:
    a, b, c = (f"lag({x}, {k}) OVER w" for k in (1, 2, 3))
    return f"(({x} - {a}) - ({a} - {b})) - (({a} - {b}) - ({b} - {c}))"


FL_SQL = f"""
raw AS (
  SELECT l_suppkey AS ep, l_shipdate, l_orderkey, l_linenumber, l_quantity AS s0, l_extendedprice AS s1, l_discount AS a0, l_tax AS a1, epoch(l_shipdate) AS ts
  FROM lineitem
), fl AS (
  SELECT *, row_number() OVER w AS rn, {', '.join(f'{_jerk(x)} AS j_{x}' for x in ('s0', 's1', 'a0', 'a1'))}
  FROM raw WINDOW w AS (PARTITION BY ep ORDER BY l_shipdate, l_orderkey, l_linenumber, s1, s0, a0, a1)
)
"""
_J = ("j_s0", "j_s1", "j_a0", "j_a1")
_A = ("a0", "a1")


def _greatest(cols: tuple[str, ...], c: str, s: str) -> str:
    return "greatest(" + ", ".join(f"coalesce(abs(({x} - {c}_{x}) / nullif({s}_{x}, 0)), 0)" for x in cols) + ")"


#: Centres c_*, scales s_*, their rounded forms rc_*, rs_*, and thresholds of the 99.9th percentile.
CAL_SQL = f"""
cj AS (SELECT {', '.join(f'median({x}) AS c_{x}' for x in _J)} FROM fl WHERE rn > 3),
ca AS (SELECT {', '.join(f'median({x}) AS c_{x}' for x in _A)} FROM fl),
sj AS (SELECT {', '.join(f'median(abs({x} - c_{x})) * 1.4826::DOUBLE AS s_{x}' for x in _J)} FROM fl, cj WHERE rn > 3),
sa AS (SELECT {', '.join(f'median(abs({x} - c_{x})) * 1.4826::DOUBLE AS s_{x}' for x in _A)} FROM fl, ca),
cal AS (
  SELECT *, {', '.join(f'round_even(c_{x} * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS rc_{x}, round_even(s_{x} * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS rs_{x}' for x in _J + _A)}
  FROM cj, ca, sj, sa
),
thr AS (
  SELECT (SELECT round_even(quantile_cont({_greatest(_J, 'c', 's')}, 0.999), 6) FROM fl, cal WHERE rn > 3) AS jt,
         (SELECT round_even(quantile_cont({_greatest(_A, 'c', 's')}, 0.999), 6) FROM fl, cal) AS act
),
scored AS (
  SELECT fl.*, CASE WHEN rn > 3 THEN {_greatest(_J, 'rc', 'rs')} END AS jerk_score, {_greatest(_A, 'rc', 'rs')} AS action_score, jt, act
  FROM fl, cal, thr
)
"""
METRICS_SQL = """
metrics AS (
  SELECT ep, count(*) AS n_frames,
    round_even(CASE WHEN count(*) > 1 THEN max(ts) - min(ts) ELSE 0 END, 4) AS duration_s,
    round_even(coalesce(count(*) FILTER (WHERE jerk_score > jt) / nullif(count(jerk_score), 0), 0)::DOUBLE, 6) AS jerk_anomalous_ratio,
    round_even(coalesce(count(*) FILTER (WHERE action_score > act) / nullif(count(*), 0), 0)::DOUBLE, 6) AS action_anomalous_ratio,
    0::DOUBLE AS missing_frame_ratio
  FROM scored GROUP BY ep
), judged AS (
  SELECT *, concat_ws('; ',
      CASE WHEN jerk_anomalous_ratio > 0.002 THEN 'jerk-anomalous frames ' || jerk_anomalous_ratio || ' > 0.002' END,
      CASE WHEN action_anomalous_ratio > 0.002 THEN 'action-anomalous frames ' || action_anomalous_ratio || ' > 0.002' END) AS reasons,
    jerk_anomalous_ratio <= 0.002 AND action_anomalous_ratio <= 0.002 AS passed
  FROM metrics
)
"""
VERDICT_SQL = f"{FL_SQL}, {CAL_SQL}, {METRICS_SQL}"


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events: frames of one dimension, the task index from the JSON, some beyond the nations."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_index"), "event_id", "ts", "value", "event_type", F.pmod(k, F.lit(30)).cast("bigint").alias("task_index")
    )


FE_SQL = """
fe AS (
  SELECT user_id AS episode_index, event_id, ts, value, event_type, (json_extract_string(props, '$.k')::BIGINT % 30)::BIGINT AS task_index FROM events
), first_task AS (
  SELECT episode_index AS ep, arg_min(task_index, (ts, event_id)) AS task_index FROM fe GROUP BY 1
), task_of AS (
  SELECT ep, coalesce(n_name, 'task_' || task_index) AS task FROM first_task LEFT JOIN nation ON n_nationkey = task_index
), counts AS (
  SELECT task, count(*) AS episodes FROM task_of GROUP BY 1
)
"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("task_index"), F.col("n_name").alias("task"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, size`` as of a repository: metadata, data, videos and others."""
    p, chunk, file = F.col("page_id"), F.pmod("page_id", F.lit(7)), F.floor(F.col("page_id") / 7)
    kind = F.pmod(p, F.lit(5))
    path = (
        F.when(kind == 0, F.format_string("meta/part-%d.json", p))
        .when(kind == 1, F.format_string("data/chunk-%03d/file-%03d.parquet", chunk, file))
        .when(kind == 2, F.format_string("videos/cam/chunk-%03d/file-%03d.mp4", chunk, file))
        .when(kind == 3, F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk, p))
        .otherwise(F.format_string("docs/%d.md", p))
    )
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.length("html").cast("bigint").alias("size"))


LISTING_SQL = """
listing AS (
  SELECT CASE page_id % 5
      WHEN 0 THEN format('meta/part-{}.json', page_id)
      WHEN 1 THEN format('data/chunk-{:03d}/file-{:03d}.parquet', page_id % 7, page_id // 7)
      WHEN 2 THEN format('videos/cam/chunk-{:03d}/file-{:03d}.mp4', page_id % 7, page_id // 7)
      WHEN 3 THEN format('data/chunk-{:03d}/episode_{:06d}.parquet', page_id % 7, page_id)
      ELSE format('docs/{}.md', page_id) END AS path, length(html)::BIGINT AS size
  FROM pages
)
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit, bytes, passed, quarantined, peak``: documents by source as the units of a run."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("unit"))
    good = F.count_if(F.col("n_chars") >= 400)
    return d.agg(
        F.sum("n_chars").cast("bigint").alias("bytes"), good.alias("passed"), (F.count(F.lit(1)) - good).alias("quarantined"), F.max("n_chars").cast("bigint").alias("peak")
    )


UNITS_SQL = """
units AS (
  SELECT source AS unit, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE n_chars >= 400) AS passed,
    count(*) FILTER (WHERE n_chars < 400) AS quarantined, max(n_chars)::BIGINT AS peak
  FROM documents GROUP BY 1
)
"""
