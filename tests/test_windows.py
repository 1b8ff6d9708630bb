"""Sliding windows: groups cut at their ends and put together once, rows without a time, one very long span."""

import math
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from tidemark.streaming import windows


@pytest.mark.parametrize("held", [1, 7, 40, 10**6])
@pytest.mark.parametrize("batch", [1, 3, 50])
def test_whole_groups(monkeypatch, held, batch):
    monkeypatch.setattr(windows, "HELD_ROWS", held)
    keys = [None] * 5 + ["a"] * 30 + ["b"] + [None] * 2 + ["c"] * 12
    spans = [0, 0, 1, 1, 1] + [k // 9 for k in range(30)] + [0] + [5, 6] + [2] * 12
    table = pa.table({"k": pa.array(keys), "s": pa.array(spans), "v": pa.array(range(len(keys)))})
    got = [(rows.column(2).to_pylist(), starts.tolist()) for rows, starts in windows._whole_groups(iter(table.to_batches(max_chunksize=batch)), [0, 1])]
    assert [v for rows, _ in got for v in rows] == list(range(len(keys)))
    whole = [rows[a:b] for rows, starts in got for a, b in zip(starts, [*starts[1:], len(rows)])]
    assert [[(keys[v], spans[v]) for v in g][0] for g in whole] == [k for i, k in enumerate(zip(keys, spans)) if i == 0 or k != (keys[i - 1], spans[i - 1])]
    assert all(len({(keys[v], spans[v]) for v in g}) == 1 for g in whole)


def test_rows_without_a_time(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a" if k % 3 else None, t0 + timedelta(seconds=k) if k % 5 else None, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "who string, t timestamp, v double").repartition(3)
    got = {r.v: (r["count"], r["sum"]) for r in windows.sliding(df, "t", "v", "10s", ["count", "sum"], ["who"]).collect()}
    for who, t, v in rows:
        near = [x for w, u, x in rows if w == who and t and u and t - timedelta(seconds=10) <= u <= t]
        assert got[v] == (pytest.approx((len(near), sum(near))) if t else (None, None))


def test_one_span_takes_time_in_proportion():
    def took(n):
        table = pa.table({"k": pa.array(np.zeros(n, np.int64)), "v": pa.array(np.arange(n, dtype=np.float64))})
        began = time.perf_counter()
        ((rows, starts),) = windows._whole_groups(iter(table.to_batches(max_chunksize=10_000)), [0])
        assert rows.num_rows == n and starts.tolist() == [0]
        return time.perf_counter() - began

    took(10_000)
    few, many = min(took(1_000_000) for _ in range(3)), min(took(4_000_000) for _ in range(3))
    assert many <= 4 * 1.6 * few + 0.05 and math.isfinite(many)
