"""One query per operator, and the SQL that must give the same rows."""

from __future__ import annotations

import contextlib
import io
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import QualityGates, SchemaGates, SignalGates
from ..functions import half_even, nan_if_null, path_class, suffix_after_dash
from ..operators import augment, budget, catalog, curate, report
from ..operators.calibrate import Calibration, calibrate
from ..operators.calibrate import list_center_scale
from ..operators.gates import combined_rate, episode_metrics, frame_scores, missing_ratio, signal_gates, summary
from ..operators.jerk import jerk_rows, list_jerk
from ..operators.quantiles import exact_percentiles
from ..operators.schema_gate import lacking, validate_many
from ..functions import list_score
from ..sources.frames import Frames
from . import views
from .views import CAL_SQL, FE_SQL, FL_SQL, LISTING_SQL, UNITS_SQL, VERDICT_SQL, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GATES = SignalGates(max_anomalous_frame_ratio=0.002)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def judged_lines(spark: SparkSession, sf_dir: str) -> tuple[Frames, DataFrame]:
    frames = views.line_frames(spark, sf_dir)
    return frames, signal_gates(frames, calibrate(frames, "lineitem"), GATES)


# --- signal gates ---------------------------------------------------------------------------------------------------


@query(f"WITH {VERDICT_SQL} SELECT ep, n_frames, duration_s, jerk_anomalous_ratio, action_anomalous_ratio, missing_frame_ratio, reasons, passed FROM judged")
def episode_verdicts(spark, sf_dir):
    _, judged = judged_lines(spark, sf_dir)
    return judged.withColumn("reasons", F.array_join("reasons", "; "))


@query(f"WITH {FL_SQL} SELECT ep, rn::INTEGER AS rn, l_orderkey, l_linenumber, j_s0, j_s1, j_a0, j_a1 FROM fl WHERE rn > 3")
def jerk_third_difference(spark, sf_dir):
    return jerk_rows(views.line_frames(spark, sf_dir)).select("ep", "rn", "l_orderkey", "l_linenumber", "j_s0", "j_s1", "j_a0", "j_a1")


_DIMS = ("j_s0", "j_s1", "j_a0", "j_a1", "a0", "a1")


@query(f"WITH {FL_SQL}, {CAL_SQL} " + " UNION ALL ".join(f"SELECT '{d}' AS signal, rc_{d} AS center, rs_{d} AS scale FROM cal" for d in _DIMS))
def robust_center_scale(spark, sf_dir):
    c = calibrate(views.line_frames(spark, sf_dir), "lineitem")
    rows = zip(_DIMS, c.jerk_center + c.action_center, c.jerk_scale + c.action_scale)
    return spark.createDataFrame([tuple(r) for r in rows], "signal string, center double, scale double")


@query(f"WITH {FL_SQL}, {CAL_SQL} SELECT 'jerk' AS kind, jt AS threshold FROM thr UNION ALL SELECT 'action', act FROM thr")
def score_thresholds(spark, sf_dir):
    c = calibrate(views.line_frames(spark, sf_dir), "lineitem")
    return spark.createDataFrame([("jerk", c.jerk_score_threshold), ("action", c.action_score_threshold)], "kind string, threshold double")


@query(f"WITH {FL_SQL}, {CAL_SQL} SELECT ep, rn::INTEGER AS rn, l_orderkey, l_linenumber, round_even(jerk_score, 6) AS jerk_score, round_even(action_score, 6) AS action_score FROM scored")
def frame_scores_all(spark, sf_dir):
    frames = views.line_frames(spark, sf_dir)
    df = frame_scores(frames, calibrate(frames, "lineitem"))
    return df.select("ep", "rn", "l_orderkey", "l_linenumber", half_even(F.col("jerk_score"), 6).alias("jerk_score"), half_even(F.col("action_score"), 6).alias("action_score"))


def _vector_sql() -> str:
    d = 64
    jerk = "[((v[i]::DOUBLE - x1[i]) - (x1[i]::DOUBLE - x2[i])) - ((x1[i]::DOUBLE - x2[i]) - (x2[i]::DOUBLE - x3[i])) FOR i IN range(1, 65)]"
    return f"""
WITH f AS (
  SELECT label, vec_id, embedding AS v, row_number() OVER w AS rn, lag(embedding, 1) OVER w AS x1, lag(embedding, 2) OVER w AS x2, lag(embedding, 3) OVER w AS x3
  FROM embeddings WHERE len(embedding) = {d} WINDOW w AS (PARTITION BY label ORDER BY vec_id)
), j AS (SELECT label, vec_id, {jerk} AS j FROM f WHERE rn > 3),
jl AS (SELECT vec_id, unnest(j) AS x, unnest(range(1, 65)) AS i FROM j),
al AS (SELECT vec_id, unnest(v)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM f),
jc AS (SELECT i, median(x) AS c FROM jl GROUP BY i), js AS (SELECT i, any_value(c) AS c, median(abs(x - c)) * 1.4826::DOUBLE AS s FROM jl JOIN jc USING (i) GROUP BY i),
ac AS (SELECT i, median(x) AS c FROM al GROUP BY i), sa AS (SELECT i, any_value(c) AS c, median(abs(x - c)) * 1.4826::DOUBLE AS s FROM al JOIN ac USING (i) GROUP BY i),
jm AS (SELECT vec_id, max(coalesce(abs((x - c) / nullif(s, 0)), 0)) AS z FROM jl JOIN js USING (i) GROUP BY 1),
am AS (SELECT vec_id, max(coalesce(abs((x - c) / nullif(s, 0)), 0)) AS z FROM al JOIN sa USING (i) GROUP BY 1)
SELECT f.vec_id, rn::INTEGER AS rn, round_even(jm.z, 6) AS jerk_score, round_even(am.z, 6) AS action_score FROM f JOIN am USING (vec_id) LEFT JOIN jm USING (vec_id)
"""


@query(_vector_sql())
def vector_frame_scores(spark, sf_dir):
    """Lists of 64 dimensions, an episode per label."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding").filter(F.size("embedding") == 64)
    df = list_jerk(v, "embedding", "label", ["vec_id"]).withColumn("a", F.transform("embedding", lambda x: x.cast("double")))
    df = df.select("vec_id", "rn", "a", "j").persist()
    try:
        ac, sa = list_center_scale(df, "a", 64)
        jc, js = list_center_scale(df.filter("rn > 3"), "j", 64)
    finally:
        df.unpersist()
    out = df.select("vec_id", "rn", half_even(F.when(F.col("rn") > 3, list_score("j", jc, js)), 6).alias("jerk_score"), half_even(list_score("a", ac, sa), 6).alias("action_score"))
    return out


@query("""
WITH g AS (
  SELECT conv_id AS ep, count(*) AS n, (max(turn) - min(turn))::DOUBLE AS duration FROM conversations GROUP BY 1
), e AS (SELECT *, round_even(duration * 1.5, 0)::BIGINT + 1 AS expected FROM g)
SELECT ep, n AS n_frames, duration,
  round_even(CASE WHEN n > 1 AND duration > 0 THEN greatest(0, (expected - n) / nullif(expected, 0)) ELSE 0 END::DOUBLE, 6) AS missing_frame_ratio
FROM e
""")
def missing_frame_ratio(spark, sf_dir):
    """Conversations are episodes of a turn a second, which should have had three in two."""
    by = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ep")).agg(
        F.count(F.lit(1)).alias("n_frames"), (F.max_by("turn", "turn") - F.min_by("turn", "turn")).cast("double").alias("duration")
    )
    return by.select("ep", "n_frames", "duration", half_even(missing_ratio(F.col("n_frames"), F.col("duration"), 1.5, F.lit(0)), 6).alias("missing_frame_ratio"))


@query("""
WITH f AS (
  SELECT user_id AS ep, CASE WHEN event_id % 97 = 0 OR event_id % 83 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE WHEN event_id % 79 = 0 THEN '-inf'::DOUBLE ELSE value END AS v
  FROM events
), z AS (SELECT ep, isnan(v) AS bad, CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE abs((v - 10) / 5) END AS z FROM f)
SELECT ep, count(*) AS n_frames, round_even(count(*) FILTER (WHERE bad) / count(*), 6) AS nan_ratio, round_even(count(*) FILTER (WHERE z > 4) / count(*), 6) AS action_ratio FROM z GROUP BY ep
""")
def nan_inf_frames(spark, sf_dir):
    """Nulls count as NaN; NaN is missing and scores 0, infinities score 0 and are not missing."""
    e = F.col("event_id")
    v = (
        F.when(e % 97 == 0, float("nan")).when(e % 83 == 0, F.lit(None).cast("double")).when(e % 89 == 0, float("inf")).when(e % 79 == 0, float("-inf")).otherwise(F.col("value"))
    )
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("ep"), "event_id", nan_if_null(v).alias("v"))
    still = Calibration("events", 1, 99.9, [0.0], [0.0], [10.0], [5.0], 0.0, 4.0)  # no jerk scores
    by = episode_metrics(Frames(df, "ep", ("event_id",), (), ("v",)), still)
    return by.select("ep", "n_frames", F.col("missing_frame_ratio").alias("nan_ratio"), F.col("action_anomalous_ratio").alias("action_ratio"))


@query(f"""WITH {VERDICT_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
  round_even(coalesce(count(*) FILTER (WHERE passed) / nullif(count(*), 0), 0)::DOUBLE, 4) AS pass_rate FROM judged""")
def gate_summary(spark, sf_dir):
    return summary(judged_lines(spark, sf_dir)[1])


@query(f"WITH {VERDICT_SQL} SELECT round_even((count(*) FILTER (WHERE passed) + 3) / (count(*) + 4)::DOUBLE, 4) AS pass_rate FROM judged")
def combined_pass_rate(spark, sf_dir):
    """Pass rate over two summaries: the verdicts', and one of 3 passed of 4."""
    one = summary(judged_lines(spark, sf_dir)[1]).select("total", "passed")
    return combined_rate(one.union(spark.createDataFrame([(4, 3)], "total bigint, passed bigint")))


@query("SELECT quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p999, quantile_cont(l_quantity, 0.25) AS q25 FROM lineitem")
def exact_percentiles_narrowed(spark, sf_dir):
    """The many-pass form that large columns take, forced on a small one."""
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    x, q = F.col("l_extendedprice"), F.col("l_quantity")
    got = exact_percentiles(df, [(x, 0.5), (x, 0.999), (q, 0.25)], df.count(), one_pass=100)
    return spark.createDataFrame([tuple(got)], "p50 double, p999 double, q25 double")


@query("SELECT len(embedding) AS width, count(*) AS n, len(embedding) = 64 AS fits FROM embeddings GROUP BY 1")
def calibration_fits(spark, sf_dir):
    """Whether vectors of each width that there is fit a calibration of 64 dimensions."""
    c = Calibration("x", 1, 99.9, [0.0] * 64, [1.0] * 64, [0.0] * 64, [1.0] * 64)
    width = F.size("embedding")
    return table(spark, sf_dir, "embeddings").groupBy(width.alias("width")).agg(F.count(F.lit(1)).alias("n")).withColumn("fits", c.fitting(F.col("width"), F.col("width")))


# --- curation and quarantine ----------------------------------------------------------------------------------------


@query(f"WITH {VERDICT_SQL} SELECT ep, l_orderkey, l_linenumber, s0, s1, a0, a1 FROM raw WHERE ep IN (SELECT ep FROM judged WHERE passed)")
def curate_passing(spark, sf_dir):
    frames, judged = judged_lines(spark, sf_dir)
    return curate.passing(frames.df.select("ep", "l_orderkey", "l_linenumber", "s0", "s1", "a0", "a1"), judged, "ep")


@query(f"WITH {VERDICT_SQL} SELECT ep AS episode_index, reasons FROM judged WHERE NOT passed")
def quarantine_rejects(spark, sf_dir):
    return curate.rejects(judged_lines(spark, sf_dir)[1]).withColumn("reasons", F.array_join("reasons", "; "))


@query(f"WITH {VERDICT_SQL} SELECT ep, rn::INTEGER AS rn, l_orderkey, l_linenumber, s0, s1, a0, a1 FROM fl WHERE rn <= 5 AND ep IN (SELECT ep FROM judged WHERE NOT passed)")
def quarantine_samples(spark, sf_dir):
    frames, judged = judged_lines(spark, sf_dir)
    out = curate.samples(frames.df, judged, list(frames.order), "ep")
    return out.select("ep", "rn", "l_orderkey", "l_linenumber", "s0", "s1", "a0", "a1")


@query(f"WITH {UNITS_SQL}, r AS (SELECT unit, bytes, coalesce(sum(bytes) OVER (ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM units) SELECT unit, bytes FROM r WHERE b < 300000")
def quarantine_subcap(spark, sf_dir):
    """Samples are written while what is there is below the cap."""
    return curate.capped(views.units(spark, sf_dir).select("unit", "bytes"), 300000, "unit", "bytes")


# --- tasks, catalog -------------------------------------------------------------------------------------------------


def event_counts(spark, sf_dir) -> DataFrame:
    first = catalog.first_tasks(views.event_frames(spark, sf_dir), ["ts", "event_id"])
    return catalog.task_counts(catalog.named(first, views.nations(spark, sf_dir)))


@query(f"WITH {FE_SQL} SELECT * FROM counts")
def task_distribution(spark, sf_dir):
    return event_counts(spark, sf_dir)


@query("SELECT doc_id AS ep, coalesce('quality_' || quality, 'task_' || doc_id) AS task FROM documents LEFT JOIN labels USING (doc_id)")
def task_name_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_index"), F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("task"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ep"), F.col("doc_id").alias("task_index"))
    return catalog.named(docs, names)


@query(f"""WITH {FE_SQL} SELECT 'v1' AS dataset_version, (SELECT count(DISTINCT episode_index) FROM fe) AS episode_count, (SELECT count(*) FROM fe) AS frame_count,
  (SELECT '{{' || string_agg('"' || task || '":' || episodes, ',' ORDER BY task) || '}}' FROM counts) AS task_distribution, 0.94::DOUBLE AS gate_pass_rate""")
def catalog_record(spark, sf_dir):
    frames = views.event_frames(spark, sf_dir)
    row = catalog.record(frames, event_counts(spark, sf_dir), version="v1", source="events", pass_rate=0.94)
    return row.select("dataset_version", "episode_count", "frame_count", "task_distribution", "gate_pass_rate")


@query("""
WITH v AS (SELECT 'v' || (o_orderkey % 50) AS dataset_version, o_custkey AS source, o_totalprice AS pass_rate, o_orderkey AS seq FROM orders)
SELECT dataset_version, source, pass_rate FROM (SELECT *, row_number() OVER (PARTITION BY dataset_version ORDER BY seq DESC) AS r FROM v) WHERE r = 1
""")
def catalog_upsert(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("v"), (F.col("o_orderkey") % 50).cast("string")).alias("dataset_version"), F.col("o_custkey").alias("source"), F.col("o_totalprice").alias("pass_rate"), F.col("o_orderkey").alias("seq")
    )
    return catalog.keep_latest(v)


def versions(spark, sf_dir) -> DataFrame:
    """A catalog made of customers' market segments."""
    c = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("v-"), F.lower("c_mktsegment")).alias("dataset_version")).agg(
        F.max("c_nationkey").cast("string").alias("source_id"), F.count(F.lit(1)).alias("episode_count"), F.sum("c_custkey").cast("bigint").alias("frame_count"),
        F.count_if(F.col("c_nationkey") < 5).alias("n"), F.max("c_custkey").alias("bytes_on_disk"),
    )
    rate = F.when(F.col("n") % 2 == 0, half_even(F.col("n") / F.col("episode_count"), 4))
    tasks = F.to_json(F.create_map(F.lit("a"), F.col("n"), F.lit("b"), F.col("episode_count")))
    return c.select("dataset_version", "source_id", "episode_count", "frame_count", rate.alias("gate_pass_rate"), "bytes_on_disk", F.lit("2024").alias("created_at"), tasks.alias("task_distribution"))


VERSIONS_SQL = """
versions AS (
  SELECT 'v-' || lower(c_mktsegment) AS dataset_version, max(c_nationkey)::VARCHAR AS source_id, count(*) AS episode_count, sum(c_custkey)::BIGINT AS frame_count,
    count(*) FILTER (WHERE c_nationkey < 5) AS n, max(c_custkey) AS bytes_on_disk, '2024' AS created_at,
    CASE WHEN count(*) FILTER (WHERE c_nationkey < 5) % 2 = 0 THEN round_even(count(*) FILTER (WHERE c_nationkey < 5) / count(*), 4) END AS gate_pass_rate
  FROM customer GROUP BY 1
)
"""


@query(f"WITH {VERSIONS_SQL} SELECT dataset_version, source_id, episode_count, frame_count, gate_pass_rate, bytes_on_disk, created_at FROM versions ORDER BY 1")
def dashboard_versions(spark, sf_dir):
    return report.versions(versions(spark, sf_dir))


@query(f"WITH {VERSIONS_SQL} SELECT dataset_version, gate_pass_rate FROM versions WHERE gate_pass_rate IS NOT NULL")
def dashboard_pass_rate(spark, sf_dir):
    return report.pass_rates(versions(spark, sf_dir))


@query(f"WITH {VERSIONS_SQL} SELECT 'b' AS task, episode_count AS episodes FROM versions WHERE dataset_version = 'v-building' UNION ALL SELECT 'a', n FROM versions WHERE dataset_version = 'v-building'")
def dashboard_task_mix(spark, sf_dir):
    return report.task_mix(versions(spark, sf_dir), "v-building")


@query(f"WITH {VERSIONS_SQL} SELECT dataset_version, 2::BIGINT AS tasks, n + episode_count AS episodes FROM versions")
def dashboard_totals(spark, sf_dir):
    return report.totals(versions(spark, sf_dir))


# --- augmentation and merging ---------------------------------------------------------------------------------------


@query(f"WITH {FE_SQL} SELECT task, 6 - episodes AS deficit FROM counts WHERE episodes < 6")
def under_represented(spark, sf_dir):
    return augment.deficits(event_counts(spark, sf_dir), 6).withColumn("deficit", F.col("deficit").cast("bigint"))


_PLAN_SQL = f"""
WITH {FE_SQL}, each AS (
  SELECT task, n_nationkey::BIGINT AS task_index, unnest(range(1, 7 - episodes)) AS k FROM counts JOIN nation ON n_name = task WHERE episodes < 6
), plan AS (
  SELECT row_number() OVER (ORDER BY task, k) - 1 + (SELECT max(episode_index) + 1 FROM fe) AS episode_index, task, task_index FROM each
  QUALIFY row_number() OVER (ORDER BY task, k) <= 20
)
"""


def planned(spark, sf_dir) -> DataFrame:
    start = views.event_frames(spark, sf_dir).agg(F.max("episode_index")).first()[0] + 1
    return augment.plan(event_counts(spark, sf_dir), views.nations(spark, sf_dir), target=6, cap=20, next_episode=start)


@query(_PLAN_SQL + "SELECT episode_index, task, task_index FROM plan")
def augment_plan(spark, sf_dir):
    return planned(spark, sf_dir)


@query(_PLAN_SQL + "SELECT task, count(*) AS generated FROM plan GROUP BY task")
def augment_per_task(spark, sf_dir):
    return planned(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("generated"))


_UNIT = Calibration("unit", 1, 99.9, [0.0] * 14, [1.0] * 14, [0.0] * 7, [1.0] * 7, 6.0, 5.0)


@query(_PLAN_SQL + "SELECT episode_index, task_index, i AS frame_index, (i / 15.0::DOUBLE)::FLOAT::DOUBLE AS timestamp FROM (SELECT *, unnest(range(0, 40)) AS i FROM plan)")
def augment_frames(spark, sf_dir):
    rows = augment.generate(planned(spark, sf_dir), _UNIT, 7, 7, length=(40, 41))
    return rows.select("episode_index", "task_index", "frame_index", F.col("timestamp").cast("double").alias("timestamp"))


@query(_PLAN_SQL + "SELECT episode_index, task_index, true AS length_ok, true AS widths_ok, true AS bounded, true AS smooth, true AS clock_ok FROM plan")
def augment_values(spark, sf_dir):
    """Trajectories of the planned episodes.  Their values are hashed uniforms, which SQL can't repeat; what they must keep
    to can be told: 120 to 259 frames, seven dimensions each, an amplitude of 0.7 at most and a step of a twentieth of that."""
    rows = augment.generate(planned(spark, sf_dir), _UNIT, 7, 7)
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    size = lambda c: F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))
    step = F.array_max(F.zip_with("action", F.lag("action").over(w), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    state = F.col("`observation.state`")
    rows = rows.withColumns({"step": F.coalesce(step, F.lit(0.0)), "late": F.abs(F.col("timestamp") - F.col("frame_index") / 15.0)})
    n = F.count(F.lit(1))
    return rows.groupBy("episode_index", "task_index").agg(
        ((n >= 120) & (n < 260)).alias("length_ok"), F.every((F.size("action") == 7) & (F.size(state) == 7)).alias("widths_ok"),
        (F.max(F.greatest(size("action"), size(state))) <= 0.7).alias("bounded"), (F.max("step") <= 0.7 * 0.05 + 1e-6).alias("smooth"), (F.max("late") < 1e-5).alias("clock_ok"),
    )


@query("""
WITH b AS (SELECT user_id AS episode_index, event_id, value, props FROM events WHERE event_id % 2 = 0),
a AS (SELECT user_id + (SELECT max(episode_index) + 1 FROM b) AS episode_index, event_id, value FROM events WHERE event_id % 2 = 1)
SELECT * FROM b UNION ALL BY NAME SELECT * FROM a
""")
def merge_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("episode_index", F.col("user_id"))
    return augment.merge(
        e.filter("event_id % 2 = 0").select("episode_index", "event_id", "value", "props"), e.filter("event_id % 2 = 1").select("episode_index", "event_id", "value")
    )


# --- schema gate ----------------------------------------------------------------------------------------------------

_NEED = QualityGates(schema=SchemaGates(required_features=("observation.state", "action"), image_keys_any_of=("cam1", "cam2")))
_DECLARED = [
    ("good", ["observation.state", "action", "cam1", "task_index"], ["cam1"], ["observation.state", "action", "task_index"], True),
    ("no action", ["observation.state", "cam2", "task"], ["cam2"], ["observation.state"], False),
    ("no image, no words", ["observation.state", "action", "task_index"], [], ["observation.state", "action"], False),
    ("declared only", ["observation.state", "action", "cam1", "language_instruction"], ["cam1"], ["action"], False),
    ("no data", ["observation.state", "action", "cam1", "task"], ["cam1"], None, False),
]


@query("""
SELECT * FROM (VALUES
  ('good', true, ''),
  ('no action', false, 'missing required feature ''action''; required feature ''action'' declared but not a data column'),
  ('no image, no words', false, 'no image feature present (none of [''cam1'', ''cam2'']); no resolvable language instruction (task_index+tasks table or language_instruction)'),
  ('declared only', false, 'required feature ''observation.state'' declared but not a data column'),
  ('no data', false, 'no data parquet found under data/')) t(dataset, passed, reasons)
""")
def schema_gate(spark, sf_dir):
    listed = spark.createDataFrame(_DECLARED, "dataset string, features array<string>, image_features array<string>, columns array<string>, has_tasks boolean")
    return validate_many(listed, _NEED).withColumn("reasons", F.array_join("reasons", "; "))


@query("""SELECT source, feature FROM (SELECT DISTINCT source FROM documents), (VALUES ('de'), ('en'), ('xx')) r(feature)
  EXCEPT SELECT source, lang FROM documents""")
def required_difference(spark, sf_dir):
    """Required features that a declaration lacks: the languages of a source's documents."""
    have = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("features"))
    return have.select("source", F.explode(lacking(("de", "en", "xx"), "features")).alias("feature"))


# --- files, budgets, units ------------------------------------------------------------------------------------------


@query(f"""WITH {LISTING_SQL}, c AS (SELECT *, CASE WHEN starts_with(path, 'meta/') THEN 0 WHEN starts_with(path, 'data/') THEN 1 WHEN starts_with(path, 'videos/') THEN 2 ELSE 3 END AS r FROM listing)
SELECT path, size, total::BIGINT AS total, total + 1000 <= 500000 AS accepted FROM (SELECT *, sum(size) OVER (ORDER BY r, path ROWS UNBOUNDED PRECEDING) AS total FROM c)""")
def acquire_prefix(spark, sf_dir):
    return budget.acquisition(views.listing(spark, sf_dir), 500000, 1000).drop("class")


@query(f"""WITH {LISTING_SQL} SELECT path, CASE WHEN starts_with(path, 'meta/') THEN 'meta' WHEN starts_with(path, 'data/') THEN 'data'
  WHEN starts_with(path, 'videos/') THEN 'video' ELSE 'other' END AS class FROM listing""")
def file_classify(spark, sf_dir):
    return views.listing(spark, sf_dir).select("path", path_class(F.col("path")).alias("class"))


_UNITS_OF = r"""
du AS (
  SELECT path, size, coalesce(nullif(regexp_extract(path, 'chunk-(\d+)/(?:file|episode)[-_](\d+)', 1), '')::BIGINT, 0) AS chunk,
    coalesce(nullif(regexp_extract(path, 'chunk-(\d+)/(?:file|episode)[-_](\d+)', 2), '')::BIGINT, 0) AS file
  FROM listing WHERE starts_with(path, 'data/') AND ends_with(path, '.parquet')
)
"""


@query(f"WITH {LISTING_SQL}, {_UNITS_OF} SELECT format('{{:03d}}-{{:03d}}', chunk, file) AS unit, path, size, chunk, file FROM du")
def unit_ids(spark, sf_dir):
    return budget.data_units(views.listing(spark, sf_dir))


_VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"


@query(f"""WITH {LISTING_SQL}, {_UNITS_OF}, v AS (SELECT path, size, format('videos/cam/chunk-{{:03d}}/file-{{:03d}}.mp4', chunk, file) AS video FROM du)
SELECT v.path, v.video, (v.size + coalesce(l.size, 0))::BIGINT AS total FROM v LEFT JOIN listing l ON l.path = v.video""")
def unit_sizes_with_videos(spark, sf_dir):
    """Each unit's data file and the video that the template names, if it is listed."""
    files = views.listing(spark, sf_dir)
    named = budget.with_videos(budget.data_units(files), files, _VIDEO, ["cam"])
    return named.select("path", F.get("videos", F.lit(0)).alias("video"), F.col("size").alias("total"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END, 0), nullif(CASE WHEN doc_id % 2 = 0 THEN n_chars END, 0), 0)::BIGINT AS size,
  CASE WHEN strpos(lang || '-' || source, '-') > 0 THEN source END AS suffix FROM documents""")
def file_size_and_suffix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    size, lfs = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("n_chars")), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))
    return d.select("doc_id", budget.file_size(size, lfs).alias("size"), suffix_after_dash(F.concat_ws("-", "lang", "source")).alias("suffix"))


@query(f"WITH {UNITS_SQL} SELECT unit, bytes, bytes > 150000 * 0.9 AS refused FROM units")
def preadmission(spark, sf_dir):
    return budget.preadmit(views.units(spark, sf_dir).select("unit", "bytes"), 150000, size="bytes")


@query(f"WITH {UNITS_SQL} SELECT unit, bytes FROM units WHERE unit NOT IN (SELECT unit FROM units WHERE bytes % 2 = 0)")
def resume_anti_join(spark, sf_dir):
    u = views.units(spark, sf_dir).select("unit", "bytes")
    return budget.pending(u, u.filter("bytes % 2 = 0"))


@query(f"WITH {UNITS_SQL} SELECT unit, bytes FROM units WHERE bytes % 2 <> 0 ORDER BY unit LIMIT 3")
def max_units(spark, sf_dir):
    u = views.units(spark, sf_dir).select("unit", "bytes")
    return budget.pending(u, u.filter("bytes % 2 = 0"), most=3)


@query(f"""WITH {UNITS_SQL}, r AS (SELECT max(peak) AS p, sum(bytes)::BIGINT AS t, count(*) AS u, sum(passed)::BIGINT AS e, sum(quarantined)::BIGINT AS q FROM units)
SELECT p AS peak_raw_bytes, t AS total_processed_bytes, u AS units_processed, e AS episodes_passed, q AS episodes_quarantined, 200000::BIGINT AS budget_bytes,
  p < 200000 AND t > 200000 AS invariant_holds, 0.2::DOUBLE AS budget_mb, round_even(p / 1e6, 3)::DOUBLE AS peak_raw_mb, round_even(t / 1e6, 3)::DOUBLE AS total_processed_mb,
  round_even(p / 200000.0, 3)::DOUBLE AS headroom_ratio, round_even(t / 200000.0, 2)::DOUBLE AS throughput_x_budget FROM r""")
def scale_report(spark, sf_dir):
    return budget.report(views.units(spark, sf_dir), 200000)


@query(f"""WITH {UNITS_SQL} SELECT unit, max(peak) OVER w AS peak, sum(bytes) OVER w::BIGINT AS processed, sum(passed) OVER w::BIGINT AS passed, sum(quarantined) OVER w::BIGINT AS quarantined
FROM units WINDOW w AS (ORDER BY unit ROWS UNBOUNDED PRECEDING)""")
def running_peak(spark, sf_dir):
    """Running maxima and totals over a run's units (a row per unit, so one task is enough)."""
    w = Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    u = views.units(spark, sf_dir)
    return u.select("unit", F.max("peak").over(w).alias("peak"), *[F.sum(c).over(w).alias(n) for c, n in (("bytes", "processed"), ("passed", "passed"), ("quarantined", "quarantined"))])


@query(f"""WITH {UNITS_SQL} SELECT unit, round_even(bytes / 1073741824.0, 4)::DOUBLE AS used_gb, round_even(greatest(200000 - bytes, 0) / 1073741824.0, 4)::DOUBLE AS remaining_gb,
  round_even(100.0 * bytes / 200000, 1)::DOUBLE AS pct FROM units""")
def usage_snapshot(spark, sf_dir):
    u = views.units(spark, sf_dir)
    return u.select("unit", *[c.alias(k) for k, c in budget.usage_columns(F.col("bytes"), F.lit(200000)).items()])


@query(f"WITH {UNITS_SQL} SELECT unit, least(1.0::DOUBLE, peak / 9000.0::DOUBLE) AS progress, round_even(peak / 9000.0::DOUBLE * 100, 1) AS pct_of_budget FROM units")
def dashboard_storage(spark, sf_dir):
    u = views.units(spark, sf_dir).select("unit", F.col("peak").alias("peak_raw_bytes"), F.lit(9000).alias("budget_bytes"))
    return report.storage(u).select("unit", "progress", "pct_of_budget")


# --- streaming ------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT unnest(range(0, 12)) AS ep), f AS (SELECT ep, unnest(range(0, 200)) AS i FROM e)
SELECT format('{:03d}', ep // 3) AS unit, ep AS episode_index, i AS frame_index, (i / 10.0::DOUBLE)::FLOAT::DOUBLE AS timestamp, ep % 4 AS task_index,
  ep % 7 = 0 AND i >= 100 AND i < 110 AS kicked, 14::BIGINT AS close_to_waves FROM f
""")
def synthetic_store(spark, sf_dir):
    """Frames of the synthetic store: which are kicked, and how many dimensions lie within their noise of the waves."""
    from ..streaming.synthetic import synthetic_frames

    rows = synthetic_frames(spark, chunks=4, frames=200)
    kicked = F.abs(F.get("action", F.lit(0))) > 10
    sign = F.when(kicked, F.when(F.col("frame_index") % 2 == 0, 50.0).otherwise(-50.0)).otherwise(0.0)
    i = F.col("frame_index").cast("double")
    state = F.transform(F.col("`observation.state`"), lambda x, d: F.abs(x - F.sin(i / 5 + d)) < 0.1)
    action = F.transform("action", lambda x, d: F.abs(x - F.when(d == 0, sign).otherwise(0.0) - F.cos(i / 6 + d)) < 0.1)
    close = F.size(F.filter(F.concat(state, action), lambda x: x))
    return rows.select(
        "unit", "episode_index", "frame_index", F.col("timestamp").cast("double").alias("timestamp"), "task_index", kicked.alias("kicked"), close.cast("bigint").alias("close_to_waves")
    )


_RUN_SQL = """
WITH u AS (SELECT unnest(range(0, 4)) AS k), e AS (SELECT k, k * 3 + unnest(range(0, 3)) AS ep FROM u)
SELECT format('{:03d}', k) AS unit, count(*) FILTER (WHERE ep % 7 <> 0) AS passed, count(*) FILTER (WHERE ep % 7 = 0) AS quarantined,
  count(*) FILTER (WHERE ep % 7 <> 0) * 200 AS frames, true AS within_budget, true AS invariant_holds FROM e GROUP BY k
"""


@query(_RUN_SQL)
def process_and_evict_stream(spark, sf_dir):
    """A synthetic store that is twice the budget, gated, curated and evicted unit by unit: its manifest, whether each unit
    kept the budget, and whether the run did.  Files are local, as a raw folder is."""
    from ..streaming import FolderSource, run_scale, synthetic_store, unit_calibration
    from ..streaming.evict import manifest

    root = Path(tempfile.mkdtemp(prefix="framelathe-scale-"))
    synthetic_store(spark, root / "store", chunks=4, frames=200)
    total = sum(f.stat().st_size for f in (root / "store" / "data").rglob("*.parquet"))
    with contextlib.redirect_stdout(io.StringIO()):  # events
        done = run_scale(spark, FolderSource(root / "store", by="chunk"), data_root=root, budget_bytes=total // 2, calibration=unit_calibration(), dataset_version="v0")
    rows = manifest(spark, root / "manifest" / "v0").select("unit", "passed", "quarantined", "frames", "peak").collect()  # four
    shutil.rmtree(root)
    kept = [(r["unit"], r["passed"], r["quarantined"], r["frames"], r["peak"] < total // 2, done.invariant_holds) for r in rows]
    return spark.createDataFrame(kept, "unit string, passed bigint, quarantined bigint, frames bigint, within_budget boolean, invariant_holds boolean")
