"""Third differences along an episode."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.frames import Frames


#: Rows of an episode from which it is split into segments, and of a segment, about.
HOT_ROWS = 5_000_000
SEGMENT_ROWS = 500_000


def third_difference(x, x1, x2, x3):
    return ((x - x1) - (x1 - x2)) - ((x1 - x2) - (x2 - x3))


def lagged(df, signal, partition, order):
    """``rn`` and ``j_<signal>`` along the order of each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    cols = {f"j_{c}": third_difference(F.col(c), *(F.lag(c, k).over(w) for k in (1, 2, 3))) for c in signal}
    return df.withColumn("rn", F.row_number().over(w)).withColumns(cols)


def with_jerk(frames: Frames, hot_rows: int | None = None, segment_rows: int = SEGMENT_ROWS) -> Frames:
    """Adds ``rn`` (from 1 within an episode) and ``j_<signal>``; jerk is null for an episode's first three frames.

    One exchange by episode serves this window and any aggregation by episode
    above it.  Differences associate as ((x-x1)-(x1-x2))-((x1-x2)-(x2-x3)).
    With ``hot_rows``, episodes of more rows are split along their order, each
    segment borrowing the three frames before it: same rows, in many tasks.
    """
    plain = lambda df: lagged(df, frames.signal, [frames.ep], frames.order)
    if hot_rows is None:
        return frames.with_df(plain(frames.df))
    large = frames.df.groupBy(frames.ep).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).collect()  # at most rows / hot_rows
    if not large:
        return frames.with_df(plain(frames.df))
    is_hot = F.col(frames.ep).isin([r[0] for r in large])
    parts = -(-max(r[1] for r in large) // segment_rows)
    split = segmented(frames, frames.df.filter(is_hot), parts)
    return frames.with_df(plain(frames.df.filter(~is_hot)).unionByName(split) if split is not None else plain(frames.df))


def segmented(frames: Frames, df, parts: int):
    """Frames of a few long episodes with ``rn`` and jerk; null where the first order column doesn't split them."""
    ep, lead = frames.ep, frames.order[0]
    place = F.col(lead).cast("timestamp").cast("double") if dict(df.dtypes)[lead].startswith("timestamp") else F.col(lead).cast("double")
    edges = df.groupBy(ep).agg(F.percentile_approx(place, [k / parts for k in range(1, parts)] or [0.5]).alias("_edges"))
    df = df.join(F.broadcast(edges), ep).withColumn("_seg", F.size(F.filter("_edges", lambda e: e < place))).drop("_edges")  # a row an episode
    sizes = df.groupBy(ep, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(ep).orderBy("_seg")
    known = sizes.withColumns({"_k": F.row_number().over(w) - 1, "_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = known.select(ep, "_seg", "_n", "_k", "_before").collect()  # at most parts + 1 rows an episode
    if min(r["_n"] for r in rows) < 3:
        return None
    schema = known.select(ep, "_seg", "_n", "_k", "_before").schema
    known = df.sparkSession.createDataFrame(rows, schema).drop("_n")
    df = df.join(F.broadcast(known), [ep, "_seg"]).drop("_seg").withColumn("_lent", F.lit(False))
    last = F.row_number().over(Window.partitionBy(ep, "_k").orderBy(*[F.desc(c) for c in frames.order]))
    lent = df.withColumn("_r", last).filter("_r <= 3").drop("_r").withColumns({"_k": F.col("_k") + 1, "_lent": F.lit(True)})
    out = lagged(df.unionByName(lent), frames.signal, [ep, "_k"], frames.order).filter(~F.col("_lent"))
    return out.withColumn("rn", (F.col("rn") + F.col("_before") - F.when(F.col("_k") > 0, 3).otherwise(0)).cast("int")).drop("_k", "_before", "_lent")


def jerk_rows(frames: Frames):
    """Only frames that have a jerk."""
    return with_jerk(frames).df.filter("rn > 3")


def list_jerk(df, column: str, ep: str, order: list[str], name: str = "j"):
    """``df`` with ``rn`` and ``name``, the jerk of a list of numbers as a list: three lags, then arithmetic by place."""
    w = Window.partitionBy(ep).orderBy(*order)
    lags = {f"_x{k}": F.lag(column, k).over(w) for k in (1, 2, 3)}
    out = df.withColumns({"rn": F.row_number().over(w), **lags})
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    x, x1, x2, x3 = (F.col(c) for c in (column, "_x1", "_x2", "_x3"))
    middle = less(x1, x2)
    return out.withColumn(name, less(less(less(x, x1), middle), less(middle, less(x2, x3)))).drop(*lags)
