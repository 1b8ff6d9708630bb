"""Trailing and tumbling windows as one query on a frame; on streams, see ``stateful``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durations import seconds

AGGREGATES = ("avg", "min", "max", "sum", "count", "std")


def _aggregate(name: str, c: Column) -> Column:
    made = {"avg": F.avg(c), "min": F.min(c), "max": F.max(c), "sum": F.sum(c), "count": F.count(c), "std": F.stddev_samp(c)}
    return made[name] if name in made else F.max(F.lit(0.0))


def number_of(c: Column) -> Column:
    """Values as numbers; what isn't one is 0 and still takes its place."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


#: A series is cut into spans of so many windows; a task holds whole spans, with the points of one window before each.
SPAN_WINDOWS = 16
#: Rows that are handed on together, as soon as a span ends.
HELD_ROWS = 200_000


def sliding(df: DataFrame, ts: str, value: str, window: str, aggregates: list[str] = ["avg"], partition_by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per row the aggregates over the closed interval [t - window, t].

    Series are cut into spans of many windows, so that no task sees a whole one.  Within a span every row's window is
    a range of the sorted rows: sums come from prefix sums, extremes from minima over powers of two.  Rows without a
    time have no window: their aggregates are null.
    """
    size = int(seconds(window) * 1_000_000)
    span = max(1, SPAN_WINDOWS * size)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_us", micros).withColumn("_x", number_of(F.col(value)))
    own = F.floor(F.col("_us") / span)
    timed = rows.where(F.col("_us").isNotNull())
    spread = timed.withColumn("_span", F.explode(F.sequence(own, F.floor((F.col("_us") + size) / span)))).withColumn("_own", F.col("_span") == own)
    keys = [*partition_by, "_span"]
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys, "_us")
    names, at = [*df.columns], {c: i for i, c in enumerate(spread.columns)}
    schema = T.StructType([*df.schema.fields, *(T.StructField(a, T.DoubleType()) for a in aggregates)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, [at[k] for k in keys]):
            made = window_aggregates(rows.column(at["_us"]).to_numpy(), rows.column(at["_x"]).to_numpy(), starts, size, aggregates)
            keep = pa.array(rows.column(at["_own"]))
            columns = [rows.column(at[c]).filter(keep) for c in names] + [pa.array(made[a]).filter(keep) for a in aggregates]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *aggregates])

    # rows without a time take part in no shuffle
    untimed = rows.where(F.col("_us").isNull()).select(*(F.col(f"`{c}`") for c in names), *(F.lit(None).cast("double").alias(a) for a in aggregates))
    return dealt.mapInArrow(run, schema).union(untimed)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, starts of groups): rows sorted by key, cut only between groups, each put together once."""
    held: list[pa.RecordBatch] = []
    starts: list[int] = []
    size, last = 0, None

    def handed() -> tuple[pa.RecordBatch, np.ndarray]:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0], np.array(starts, np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            same = pa.compute.equal(c.slice(1), c.slice(0, len(c) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            both = pa.compute.and_(c.slice(1).is_null(), c.slice(0, len(c) - 1).is_null()).to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | both)
        first = [b.column(k)[0] for k in keys]
        new[0] = last is None or any(not (x.equals(y) or not (x.is_valid or y.is_valid)) for x, y in zip(first, last))
        last = [b.column(k)[b.num_rows - 1] for k in keys]
        at = np.flatnonzero(new)
        if len(at) and size + int(at[-1]) >= HELD_ROWS:
            cut = int(at[-1])
            if cut:
                held.append(b.slice(0, cut))
                starts += (at[:-1] + size).tolist()
            if held:
                yield handed()
            held, starts, size = [b.slice(cut)], [0], b.num_rows - cut
        else:
            held.append(b)
            starts += (at + size).tolist()
            size += b.num_rows
    if held:
        yield handed()


def window_aggregates(us: np.ndarray, x: np.ndarray, starts: np.ndarray, size: int, aggregates: list[str]) -> dict[str, np.ndarray]:
    """Aggregates over [t - size, t] for each row of groups that begin at ``starts``; times ascend within a group."""
    n = len(us)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    low = us.min() if n else 0
    # one ascending key for all groups: groups lie further apart than a window reaches
    apart = int(us.max() - low + size + 1) if n else 1
    place = (us - low) + group * apart if len(starts) * apart < 1 << 62 else None
    if place is not None:
        lo, hi = np.searchsorted(place, place - size, "left"), np.searchsorted(place, place, "right")
    else:
        lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
        for a, b in zip(starts, np.append(starts[1:], n)):
            lo[a:b], hi[a:b] = a + np.searchsorted(us[a:b], us[a:b] - size, "left"), a + np.searchsorted(us[a:b], us[a:b], "right")
    lo = np.maximum(lo, starts[group])
    count = (hi - lo).astype(np.float64)
    finite = np.isfinite(x)
    plain = np.where(finite, x, 0.0)
    # a group's mean is taken off first: prefix sums then lose no digits of the spread
    mean = (np.add.reduceat(plain, starts) / np.diff(np.append(starts, n)))[group] if n else plain
    d = np.where(finite, plain - mean, 0.0)
    # extended precision: a far value elsewhere in the span must not cost a window its digits
    over = lambda v: ((c := np.append(np.longdouble(0), np.cumsum(v, dtype=np.longdouble)))[hi] - c[lo]).astype(np.float64)
    odd = None
    if not finite.all():
        nan, up, down = over(np.isnan(x)), over(x == np.inf), over(x == -np.inf)
        odd = np.select([(nan > 0) | ((up > 0) & (down > 0)), up > 0, down > 0], [np.nan, np.inf, -np.inf], 0.0)
    out: dict[str, np.ndarray] = {}
    s1 = over(d) if {"avg", "sum", "std"} & set(aggregates) else None
    for a in aggregates:
        if a == "count":
            out[a] = count
        elif a in ("avg", "sum"):
            v = s1 / count + mean
            v = v * count if a == "sum" else v
            out[a] = v if odd is None else np.where(odd == 0, v, odd)
        elif a == "std":
            v = np.sqrt(np.maximum(over(d.astype(np.longdouble) ** 2) - s1 * s1 / count, 0) / np.maximum(count - 1, 1))
            v = np.where(count > 1, v, 0.0)
            out[a] = v if odd is None else np.where((odd == 0) | (count < 2), v, np.nan)
        elif a in ("min", "max"):
            out[a] = _extremes(x, lo, hi, np.fmin if a == "min" else np.maximum)
        else:
            out[a] = np.zeros(n)
    return out


def _extremes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """pick over x[lo:hi] of each row: two overlapping stretches of a power of two cover a range."""
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out, level = np.empty(len(x)), x
    for k in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = pick(level[lo[own]], level[hi[own] - (1 << k)])
        level = pick(level[: len(level) - (1 << k)], level[1 << k :])
    return out


def tumbling(df: DataFrame, ts: str, value: str, window: str, aggregates: list[str] = ["avg"], partition_by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per epoch-aligned interval the aggregates; works on frames and on streams with a watermark."""
    kind = df.schema[ts].dataType.simpleString()
    x = number_of(F.col(value))
    out = df.groupBy(*partition_by, F.window(F.col(ts), f"{seconds(window)} seconds").alias("_w")).agg(*(F.coalesce(_aggregate(a, x).cast("double"), F.lit(0.0)).alias(a) for a in aggregates))
    return out.select(*partition_by, F.col("_w.start").cast(kind).alias("start"), *aggregates)
