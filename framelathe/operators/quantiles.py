"""Exact percentiles of whole columns at any size.

Columns become rows ``(k, v)``, so one small plan serves any number of them and
each is aggregated by itself.  Up to ``ONE_PASS_ROWS`` values a column takes
Spark's exact ``percentile``.  Longer ones are narrowed: approximate percentiles
(mergeable sketches) bracket the wanted ranks, counts below the bracket make the
ranks exact, until few enough distinct values are left to count one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_PASS_ROWS = 20_000
#: An approximate percentile's rank is off by the number of rows over this at most.
ACCURACY = 1_000
#: Distinct values that come to the driver in the last pass, over all columns.
FEW_VALUES = 200_000


def long_form(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """``k, v``: the values of each column, nulls left out."""
    return df.select(F.posexplode(F.array(*[v.cast("double") for v in values])).alias("k", "v")).filter("v is not null")


def by_column(values: Sequence[float]) -> Column:
    """The value that belongs to a row's column."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("k") + 1)


class Sought:
    """A pair of neighbouring ranks of one column, and the bracket that holds them."""

    def __init__(self, n: int, p: float):
        x = p * (n - 1)
        self.low, self.high, self.part = math.floor(x), math.ceil(x), x - math.floor(x)
        self.a, self.b, self.below, self.inside = -math.inf, math.inf, 0, n
        self.values: tuple[float, float] | None = None

    def fractions(self, slack: float) -> tuple[float, float]:
        """Where in the bracket its next ends are looked for."""
        off = slack * self.inside / ACCURACY + 1
        place = lambda rank: min(1.0, max(0.0, rank / self.inside))
        return place(self.low - self.below - off), place(self.high - self.below + off)

    def result(self) -> float:
        lo, hi = self.values
        return lo if self.part == 0 or lo == hi else (1 - self.part) * lo + self.part * hi


def narrowed(rows: DataFrame, sought: list[Sought], few: int) -> None:
    """Fills the values of those sought; ``rows`` is read twice a round, and each leaves a hundredth of them or so."""
    slack = 2.0
    while todo := [k for k, s in enumerate(sought) if s.values is None]:
        own = rows.filter(F.col("k").isin(todo))
        inside = (F.col("v") >= by_column([s.a for s in sought])) & (F.col("v") <= by_column([s.b for s in sought]))
        wanted = {k: sought[k].fractions(slack) for k in todo}
        ask = sorted({f for pair in wanted.values() for f in pair} - {0.0, 1.0})
        at: dict[int, dict[float, float]] = {k: {} for k in todo}
        if ask:
            for r in own.filter(inside).groupBy("k").agg(F.percentile_approx("v", ask, ACCURACY).alias("at")).collect():  # a row a column
                at[r["k"]] = dict(zip(ask, r["at"]))
        ends = {k: (at[k].get(f, sought[k].a), at[k].get(g, sought[k].b)) for k, (f, g) in wanted.items()}
        low, high = (by_column([ends.get(k, (0.0, 0.0))[side] for k in range(len(sought))]) for side in (0, 1))
        # values one by one if few enough must lie between the ends, or the sketch can't part them any more
        last = [k for k in todo if sought[k].inside * (wanted[k][1] - wanted[k][0] + 2 / ACCURACY) <= few or ends[k] == (sought[k].a, sought[k].b)]
        place = F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0)
        value = F.when((place == 0) & F.col("k").isin(last), F.col("v"))
        counts = own.groupBy("k", place.alias("place"), value.alias("v")).count().toPandas().sort_values(["k", "place", "v"])  # at most few a column
        for k in todo:
            s, mine = sought[k], counts[counts["k"] == k]
            below, here = int(mine.loc[mine["place"] < 0, "count"].sum()), mine[mine["place"] == 0]
            held = int(here["count"].sum())
            if not below <= s.low <= s.high < below + held:  # beyond the sketch's promise: look in a wider bracket
                slack *= 4
                continue
            s.a, s.b, s.below, s.inside = *ends[k], below, held
            if k in last:
                upto = here["count"].cumsum().to_numpy() + below
                s.values = tuple(float(here["v"].iloc[int(upto.searchsorted(rank, "right"))]) for rank in (s.low, s.high))
            elif s.a == s.b:
                s.values = (s.a, s.a)


def exact_percentiles(df: DataFrame, wanted: Sequence[tuple[Column, float]], rows: int | Sequence[int], one_pass: int = ONE_PASS_ROWS) -> list[float | None]:
    """Linearly interpolated percentiles (fractions) of double columns without NaN, nulls passed over.

    ``rows``: how many values each column has, one number for all or one for
    each; None for a column without any.
    """
    counts = [rows] * len(wanted) if isinstance(rows, int) else list(rows)
    todo = [i for i, n in enumerate(counts) if n]
    out: list[float | None] = [None] * len(wanted)
    if todo:
        found = long_percentiles(long_form(df, [wanted[i][0] for i in todo]), [wanted[i][1] for i in todo], [counts[i] for i in todo], one_pass)
        for i, x in zip(todo, found):
            out[i] = x
    return out


def long_percentiles(values: DataFrame, fractions: Sequence[float], counts: Sequence[int], one_pass: int = ONE_PASS_ROWS) -> list[float]:
    """The same of ``values(k, v)``: a fraction and a count, not 0, for each k from 0 on."""
    if max(counts) <= one_pass:
        ps = sorted({float(p) for p in fractions})
        found = values.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("at")).collect()  # a row a column
        at = {r["k"]: r["at"] for r in found}
        return [at[k][ps.index(float(p))] for k, p in enumerate(fractions)]
    sought = [Sought(n, float(p)) for n, p in zip(counts, fractions)]
    narrowed(values, sought, max(100, min(one_pass, FEW_VALUES // len(sought))))
    return [s.result() for s in sought]
