"""Frames: a table with an episode key, a total order within an episode, and signal columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nan_if_null


@dataclass(frozen=True)
class Frames:
    """``df`` has the columns named here; state and action are one double column per dimension, nulls as NaN.

    ``order`` must be a total order within an episode: nothing relies on the
    order of rows in files.  ``ts`` is in seconds.
    """

    df: DataFrame
    ep: str
    order: tuple[str, ...]
    state: tuple[str, ...]
    action: tuple[str, ...]
    ts: str | None = None

    @property
    def signal(self) -> tuple[str, ...]:
        return self.state + self.action

    def with_df(self, df: DataFrame) -> Frames:
        return replace(self, df=df)


def from_arrays(
    df: DataFrame, state_dims: int, action_dims: int, *, state: str = "observation.state", action: str = "action",
    ep: str = "episode_index", ts: str = "timestamp", frame: str = "frame_index",
) -> Frames:
    """Frames of list columns whose widths the dataset declares.  A null list is a frame of NaN, one of another width raises.

    Order is ``frame_index`` where there is one, then the timestamp.
    """
    cols = df.columns
    if state not in cols:
        state_dims = 0
    order = [c for c in (frame, ts) if c in cols]
    if not order:
        raise ValueError("frames need a frame index or a timestamp for their order")
    wide = []
    for name, n, tag in ((state, state_dims, "s"), (action, action_dims, "a")):
        c = F.col(f"`{name}`")
        for i in range(n):
            value = F.when(c.isNull() | (F.size(c) == n), F.get(c, F.lit(i)).cast("double"))
            if i == 0:  # looked at once a list
                value = value.otherwise(F.raise_error(F.format_string(f"{name}: %d values, {n} declared", F.size(c))).cast("double"))
            wide.append(nan_if_null(value).alias(f"{tag}{i}"))
    clock = F.col(ts).cast("double") if ts in cols else F.lit(None).cast("double")
    out = df.select(F.col(ep).alias("ep"), *[F.col(c).alias(f"o_{c}") for c in order], clock.alias("ts"), *wide)
    return Frames(
        out, "ep", tuple(f"o_{c}" for c in order), tuple(f"s{i}" for i in range(state_dims)), tuple(f"a{i}" for i in range(action_dims)), "ts"
    )
