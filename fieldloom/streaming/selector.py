"""A selector of frames worth keeping, over a stream or a finished table.

For each camera, frames in order of time: the first is kept, rare ones are kept, then one comes too soon after the
last kept, or is dense, or long awaited (heartbeat), or no news at all; after a warm-up, one is kept whose step (the
distance to the frame before) is among the largest of the last steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    target: float = 0.08
    window: int = 720
    warm_up: int = 60
    min_gap: int = 3
    max_gap: int = 300
    dense: int = 8
    least_novelty: float = 1e-4


@dataclass
class State:
    steps: list[float] = field(default_factory=list)
    last: list[float] | None = None
    kept: list[float] | None = None
    since: int = 0
    seen: int = 0


def distance(a: list[float] | None, b: np.ndarray) -> float:
    if a is None:
        return 1.0
    a = np.asarray(a)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(1 - a @ b / size) if size else 1.0


def decide(s: State, vec: np.ndarray, rare: bool, n_objects: int, p: Policy) -> str | None:
    """Why the frame is kept, or None; moves the state on."""
    step, first = round(distance(s.last, vec), 6), s.last is None
    novelty = round(distance(s.kept, vec), 6)
    s.seen += 1
    s.since += 1
    if not first:
        s.steps = [*s.steps, step][-p.window :]
    threshold = float(np.percentile(np.array(s.steps, np.float32), 100 * (1 - p.target))) if s.steps else None
    s.last = vec.tolist()
    if first:
        why = "first"
    elif rare:
        why = "rare"
    elif s.since < p.min_gap:
        why = None
    elif n_objects >= p.dense:
        why = "dense"
    elif s.since >= p.max_gap:
        why = "heartbeat"
    elif novelty <= p.least_novelty or s.seen <= p.warm_up:
        why = None
    else:
        why = "novel" if threshold is not None and step >= threshold else None
    if why:
        s.kept, s.since = s.last, 0
    return why


def run_through(rows: pd.DataFrame, state: State, policy: Policy) -> pd.DataFrame:
    why = [decide(state, np.asarray(r.vec, float), bool(r.rare), int(r.n_objects), policy) for r in rows.itertuples()]
    return rows.assign(why=why)[[w is not None for w in why]][["camera", "ts", "why"]]


def select_batch(df: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(camera, ts, why) of kept frames from (camera, ts, vec, rare, n_objects)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return run_through(rows.sort_values("ts"), State(), policy)

    return df.groupBy("camera").applyInPandas(run, "camera string, ts timestamp, why string")


STATE = "steps array<double>, last array<double>, kept array<double>, since int, seen int"


def select_stream(df: DataFrame, policy: Policy = Policy(), late: str = "10 seconds") -> DataFrame:  # noqa: B008
    """The same over a stream. A micro-batch is ordered by time within each camera; frames that come later than
    `late` after a newer one was seen are dropped by the watermark, so order holds up to batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = State()
        if store.exists:
            steps, last, kept, since, seen = store.get
            state = State(list(steps), None if last is None else list(last), None if kept is None else list(kept), since, seen)
        rows = pd.concat(list(batches)).sort_values("ts")
        found = run_through(rows, state, policy)
        store.update(tuple(asdict(state).values()))
        yield found

    from pyspark.sql.streaming.state import GroupStateTimeout

    watched = df.withWatermark("ts", late)
    return watched.groupBy("camera").applyInPandasWithState(run, "camera string, ts timestamp, why string", STATE, "append", GroupStateTimeout.NoTimeout)


def from_events(events: DataFrame, dim: int = 4) -> DataFrame:
    """The events table as frames of cameras: a vector from its value and kind."""
    angle = F.col("value") / 40
    vec = F.array(F.cos(angle), F.sin(angle), *(F.lit(0.1) for _ in range(dim - 2)))
    return events.select(F.pmod("user_id", F.lit(5)).cast("string").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), vec.alias("vec"), (F.col("event_type") == "error").alias("rare"), F.lit(1).alias("n_objects"))
