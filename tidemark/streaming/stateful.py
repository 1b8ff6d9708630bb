"""Windows of a stream as keyed state: reordering by event-time timers, drop counts, and rules over the window's points.

A key's rows of one micro-batch come in no order, so they are taken by time, all at once, as arrays.

* ``allowed lateness``: points wait in ``pending`` until the key's highest time less the lateness has passed them, or,
  where a key falls silent, until the stream's watermark has: an event-time timer is set for that.  What is older than
  the last release is late.  When a stream has ended, ``flushed`` releases the rest from the stored state.
* ``sliding`` windows hold the points of [highest time - size, highest time], ``tumbling`` ones those of the newest
  interval; older points are late.  ``max_points`` keeps the newest ones.

State is three variables: ``points`` (list), ``pending`` (list) and ``marks`` (times and counts).  New points are
appended; the list is rewritten when half of it has left the window.  The query needs Spark's RocksDB state store:
start it within ``state_store(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..durations import seconds
from .alerts import COMPARE, Condition
from .windows import number_of

STREAM_SCHEMA = (
    "series string, windowEnd double, pointCount long, avg double, min double, max double, sum double, std double, lateDropped long, overflowDropped long, "
    "alerts array<struct<rule: int, triggered: boolean, value: double, at: double>>"
)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_MARKS = "top double, newest double, released double, late long, overflow long"


class Marks(NamedTuple):
    """Of a key: highest time seen, highest time in the window, last time released, points dropped."""

    top: float | None = None
    newest: float | None = None
    released: float | None = None
    late: int = 0
    overflow: int = 0


@dataclass(frozen=True)
class Shape:
    """What a stream's windows are. ``rules`` reads column 2 + k of the points for its k-th condition."""

    size: float
    kind: str = "sliding"
    max_points: int | None = None
    lateness: float | None = None
    rules: tuple[Condition | None, ...] = ()
    now: float | None = None

    @property
    def columns(self) -> list[str]:
        return ["t", "v", *(f"c{k}" for k in range(len(self.rules)))]

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} double" for c in self.columns)


def by_time(points: np.ndarray) -> np.ndarray:
    return points[np.argsort(points[:, 0], kind="stable")]


def release(pending: np.ndarray, fresh: np.ndarray, marks: Marks, lateness: float, watermark: float = -np.inf) -> tuple[np.ndarray, np.ndarray, Marks]:
    """(released points by time, still pending, marks)."""
    late = fresh[:, 0] < (-np.inf if marks.released is None else marks.released)
    held = by_time(np.concatenate([pending, fresh[~late]]))
    top = max([*([] if marks.top is None else [marks.top]), *fresh[:, 0].tolist()], default=None)
    cut = int(np.searchsorted(held[:, 0], max(watermark, -np.inf if top is None else top - lateness), "right"))
    released = float(held[cut - 1, 0]) if cut else marks.released
    return held[:cut], held[cut:], marks._replace(top=top, released=released, late=marks.late + int(late.sum()))


def in_window(points: np.ndarray, newest: float | None, shape: Shape) -> np.ndarray:
    if newest is None:
        return points
    t = points[:, 0]
    return points[t >= newest - shape.size] if shape.kind != "tumbling" else points[np.floor(t / shape.size) == np.floor(newest / shape.size)]


def advance(points: np.ndarray, fresh: np.ndarray, marks: Marks, shape: Shape) -> tuple[np.ndarray, np.ndarray, Marks]:
    """(the window's points by time, those of ``fresh`` that came in time, marks)."""
    if not len(fresh):
        return by_time(in_window(points, marks.newest, shape)), fresh, marks
    t = fresh[:, 0]
    late = np.zeros(len(fresh), bool)
    if marks.newest is not None:
        late = t < marks.newest - shape.size if shape.kind != "tumbling" else np.floor(t / shape.size) < np.floor(marks.newest / shape.size)
    accepted = fresh[~late]
    newest = max([*([] if marks.newest is None else [marks.newest]), *accepted[:, 0].tolist()], default=None)
    every = by_time(np.concatenate([in_window(points, marks.newest, shape), accepted]))
    overflow, most = 0, shape.max_points
    kept = in_window(every, newest, shape)
    if most is not None:
        if shape.kind == "tumbling":
            sizes = np.unique(np.floor(every[:, 0] / shape.size), return_counts=True)[1]
            overflow = int(np.maximum(sizes - most, 0).sum())
        elif len(every) > most:  # a point is pushed out by the one ``most`` places on, if still in the window then
            overflow = int((every[:-most, 0] >= every[most:, 0] - shape.size).sum()) if most else len(every)
        kept = kept[len(kept) - min(most, len(kept)) :]
    return kept, accepted, marks._replace(newest=newest, late=marks.late + int(late.sum()), overflow=marks.overflow + overflow)


def aggregates(points: np.ndarray) -> dict[str, float]:
    v = points[:, 1]
    if not len(v):
        return dict.fromkeys(("avg", "min", "max", "sum", "std"), 0.0)
    return {"avg": float(v.mean()), "min": float(v.min()), "max": float(v.max()), "sum": float(v.sum()), "std": float(v.std(ddof=1)) if len(v) > 1 else 0.0}


def judged(points: np.ndarray, column: int, c: Condition, now: float) -> dict[str, Any]:
    """A condition over a window's points, whose ``column`` is the condition's: whether it holds, its value, and the time of the point that made it hold."""
    t, x = points[:, 0], points[:, column]
    known = ~np.isnan(x)
    value = at = None
    if c.kind == "simple":
        hits = np.flatnonzero(known & COMPARE[c.operator](x, c.threshold))
        pick = hits[:1] if len(hits) else np.flatnonzero(known)[-1:]
        if len(pick):
            value, at = float(x[pick[0]]), float(t[pick[0]])
        return {"triggered": bool(len(hits)), "value": value, "at": at if len(hits) else None}
    if c.kind == "rate":  # x is 1 where the text matches
        span = seconds(c.window)
        value = float((known & (x == 1) & (t >= now - span)).sum() / (span / 60)) if span else None
    else:
        inside = points[known & (t >= t[known].max() - seconds(c.window))] if known.any() else points[:0]
        if len(inside):
            value = len(inside) * 1.0 if c.aggregate == "count" else aggregates(inside[:, [0, column]]).get(c.aggregate, 0.0)
    hit = value is not None and bool(COMPARE[c.operator](value, c.threshold))
    return {"triggered": hit, "value": value, "at": float(t.max()) if hit and len(t) else None}


def _row(series: str, points: np.ndarray, marks: Marks, shape: Shape, now: float) -> pd.DataFrame:
    found = [{"rule": k, **judged(points, 2 + k, c, now)} for k, c in enumerate(shape.rules) if c is not None]
    end = float(points[-1, 0]) if len(points) else 0.0
    return pd.DataFrame({"series": [series], "windowEnd": [end], "pointCount": [len(points)], **{k: [v] for k, v in aggregates(points).items()}, "lateDropped": [marks.late], "overflowDropped": [marks.overflow], "alerts": [found]})


def _array(rows: Iterator[tuple], width: int) -> np.ndarray:
    return np.array([tuple(np.nan if x is None else x for x in r) for r in rows], np.float64).reshape(-1, width)


def _tuples(points: np.ndarray) -> list[tuple]:
    return [tuple(r) for r in points.tolist()]


class _Windows(StatefulProcessor):
    def __init__(self, shape: Shape):
        self.shape = shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", self.shape.schema)
        self.pending = handle.getListState("pending", self.shape.schema)
        self.marks = handle.getValueState("marks", _MARKS)

    def _listed(self, state) -> np.ndarray:
        return _array(state.get() if state.exists() else iter(()), len(self.shape.columns))

    def _keep(self, state, points: np.ndarray) -> None:
        if len(points):
            state.put(_tuples(points))
        elif state.exists():
            state.clear()

    def _step(self, key: Any, fresh: np.ndarray, timer_values) -> Iterator[pd.DataFrame]:
        shape = self.shape
        marks = Marks(*self.marks.get()) if self.marks.exists() else Marks()
        if shape.lateness is not None:
            fresh, waiting, marks = release(self._listed(self.pending), fresh, marks, shape.lateness, timer_values.getCurrentWatermarkInMs() / 1000)
            self._keep(self.pending, waiting)
            if len(waiting):
                self.handle.registerTimer(int(np.ceil(waiting[-1, 0] * 1000)))
        listed = self._listed(self.points)
        kept, accepted, marks = advance(listed, fresh, marks, shape)
        if shape.max_points is None and len(listed) and len(listed) + len(accepted) < 2 * len(kept):
            if len(accepted):
                self.points.appendList(_tuples(accepted))
        else:
            self._keep(self.points, kept)
        self.marks.update(tuple(marks))
        now = shape.now if shape.now is not None else timer_values.getCurrentProcessingTimeInMs() / 1000
        yield _row(key[0], kept, marks, shape, now)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = np.concatenate([b[self.shape.columns].to_numpy(np.float64) for b in rows])
        yield from self._step(key, points[np.lexsort((points[:, 1], points[:, 0]))], timerValues)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, np.zeros((0, len(self.shape.columns))), timerValues)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these windows need, for queries started within; the session's setting is as before at its end."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def shape_of(window: str = "5m", kind: str = "sliding", max_points: int | None = None, lateness: str | None = None, conditions: Sequence[Condition | None] = (), now: float | None = None) -> Shape:
    return Shape(float(seconds(window)), kind, max_points, float(seconds(lateness)) if lateness else None, tuple(conditions), now)


def _watched(c: Condition | None, stream: DataFrame, value: str) -> Column:
    """A condition's column as a number; ``value`` stands for the window's values where there is no such column."""
    if c is None or not (c.column in stream.columns or c.column == "value"):
        return F.lit(None).cast("double")
    column = F.col(c.column if c.column in stream.columns else value)
    return (column.cast("string") == c.match).cast("double") if c.kind == "rate" else column.cast("string").try_cast("double")


def stream_windows(stream: DataFrame, ts: str, value: str, shape: Shape, key: str | None = None) -> DataFrame:
    """One row per key and micro-batch: the window's aggregates, drop counts, and every rule's verdict over its points.

    Without ``key`` the stream is one series, whose window is one state.
    """
    moment = F.col(ts).cast("timestamp")
    series = F.coalesce(F.col(key).cast("string"), F.lit("null")) if key else F.lit("all")
    timed = stream.withColumn("_moment", moment)
    if shape.lateness is not None:
        timed = timed.withWatermark("_moment", f"{int(shape.lateness)} seconds")
    # a time of its own, without the watermark's mark: Spark would drop late rows before they are counted
    t = (F.unix_micros("_moment") / 1e6).alias("t")
    rows = timed.where("_moment is not null").select(series.alias("series"), t, number_of(F.col(value)).alias("v"), *(_watched(c, stream, value).alias(f"c{k}") for k, c in enumerate(shape.rules)))
    mode = "none" if shape.lateness is None else "eventtime"
    return rows.groupBy("series").transformWithStateInPandas(_Windows(shape), STREAM_SCHEMA, "Update", mode)


def flushed(spark: SparkSession, checkpoint: str, shape: Shape) -> DataFrame:
    """The windows of an ended stream once all that still waits is released: a row per key with pending points."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    point = lambda name, kind: read(name).select("key.series", F.lit(kind).alias("kind"), *(F.col(f"list_element.{c}").alias(c) for c in shape.columns), *(F.lit(None).cast(t).alias(m) for m, t in (x.split() for x in _MARKS.split(", "))))
    marks = read("marks").select("key.series", F.lit("marks").alias("kind"), *(F.lit(None).cast("double").alias(c) for c in shape.columns), *(F.col(f"value.{m.split()[0]}") for m in _MARKS.split(", ")))
    rows = point("points", "points").union(point("pending", "pending")).union(marks)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: group.loc[group["kind"] == kind, shape.columns].to_numpy(np.float64)
        pending = of("pending")
        if not len(pending):
            return _row("", np.zeros((0, len(shape.columns))), Marks(), shape, 0.0).iloc[:0]
        (m,) = group.loc[group["kind"] == "marks", list(Marks._fields)].itertuples(index=False)
        held = Marks(*(None if pd.isna(x) else x for x in m[:3]), int(m[3]), int(m[4]))
        kept, _, held = advance(of("points"), by_time(pending), held, shape)
        return _row(group["series"].iloc[0], kept, held, shape, shape.now if shape.now is not None else float(pending[:, 0].max()))

    return rows.groupBy("series").applyInPandas(run, STREAM_SCHEMA)
