"""Streams: windows as keyed state against plain loops, reordering, completion, rules over window points and micro-batches."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tidemark.plans.engine import Engine
from tidemark.plans.model import Spec
from tidemark.sources.registry import SourceRegistry
from tidemark.streaming import stateful
from tidemark.streaming.alerts import parse

by_t = lambda p: p[0]
T0 = datetime(2024, 1, 1)


def plain(batches, size, kind="sliding", most=None, lateness=None):
    """Point by point, each batch by time: (points in the window, late, overflow) after each batch and at the end."""
    window, pending, top, newest, released, late, overflow, out = [], [], None, None, None, 0, 0, []

    def add(t, v):
        nonlocal newest, late, overflow, window
        same = lambda x: math.floor(x / size) == math.floor(newest / size)
        if newest is not None and (t < newest - size if kind == "sliding" else t < newest and not same(t)):
            late += 1
            return
        newest = t if newest is None else max(newest, t)
        window = sorted((p for p in [*window, (t, v)] if (p[0] >= newest - size if kind == "sliding" else same(p[0]))), key=by_t)
        while most is not None and len(window) > most:
            window.pop(0)
            overflow += 1

    for batch in batches:
        for t, v in sorted(batch):
            if lateness is None:
                add(t, v)
                continue
            if released is not None and t < released:
                late += 1
                continue
            top = t if top is None else max(top, t)
            pending.append((t, v))
            due = sorted((p for p in pending if p[0] <= top - lateness), key=by_t)
            pending = [p for p in pending if p[0] > top - lateness]
            for p in due:
                add(*p)
                released = p[0]
        out.append((sorted(window), late, overflow))
    for p in sorted(pending, key=by_t):
        add(*p)
    return out, (sorted(window), late, overflow)


@pytest.mark.parametrize("kind", ["sliding", "tumbling"])
@pytest.mark.parametrize("most", [None, 3, 10])
@pytest.mark.parametrize("lateness", [None, 4.0])
def test_steps_equal_a_plain_loop(kind, most, lateness):
    rng = random.Random(7)
    batches = [[(round(i * 6 + rng.uniform(-35, 6), 1), rng.uniform(-5, 5)) for _ in range(rng.randrange(1, 30))] for i in range(60)]
    shape = stateful.Shape(20.0, kind, most, lateness)
    points = pending = np.zeros((0, 2))
    marks = stateful.Marks()
    want, last = plain(batches, 20.0, kind, most, lateness)
    for batch, (window, late, overflow) in zip(batches, want):
        fresh = np.array(sorted(batch))
        if lateness is not None:
            fresh, pending, marks = stateful.release(pending, fresh, marks, lateness)
        points, _, marks = stateful.advance(points, fresh, marks, shape)
        assert sorted(map(tuple, points.tolist())) == window and (marks.late, marks.overflow) == (late, overflow)
    points, _, marks = stateful.advance(points, stateful.by_time(pending), marks, shape)
    assert sorted(map(tuple, points.tolist())) == last[0] and (marks.late, marks.overflow) == last[1:]
    assert marks.late and (most != 3 or marks.overflow)


def test_conditions_over_window_points():
    points = np.array([[0.0, 1, 5], [60, 9, np.nan], [120, 2, 7], [180, 3, 6]])
    judge = lambda text, column, now=180.0: tuple(stateful.judged(points, column, parse(text), now).values())
    assert judge("v > 8", 1) == (True, 9.0, 60.0) and judge("v > 9", 1) == (False, 3.0, None)
    assert judge("w >= 7", 2) == (True, 7.0, 120.0)
    assert judge("avg(v, 1m) > 2", 1) == (True, 2.5, 180.0) and judge("std(v, 0s) > 0", 1) == (False, 0.0, None)
    assert judge("count(w, 5m) == 3", 2) == (True, 3.0, 180.0)
    flags = np.array([[0.0, 0, 1], [170, 0, 1], [175, 0, 0]])
    assert tuple(stateful.judged(flags, 2, parse('rate(k, "x", 1m) >= 1'), 180.0).values()) == (True, 1.0, 175.0)
    assert stateful.judged(np.zeros((0, 2)), 1, parse("avg(v, 1m) > 2"), 0.0) == {"triggered": False, "value": None, "at": None}


class Files:
    def query(self, spark, query, filter=None, time_range=None):
        return spark.readStream.schema("t timestamp, v double, k string").option("maxFilesPerTrigger", 1).parquet(query)


def replay(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "t timestamp, v double, k string").coalesce(1).write.mode("append").parquet(folder)
        import glob
        import os

        for f in sorted(glob.glob(f"{folder}/part-*.parquet"), key=os.path.getmtime)[n:]:
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))


def run(spark, folder, outputs, clock=None, **parameters):
    sent = []
    engine = Engine(spark, SourceRegistry({"files": Files()}), clock=clock)
    engine.publisher.publish = lambda topic, payload: sent.append(payload)
    spec = Spec.from_dict({"specId": "s", "version": "1.0.0", "inputSources": [{"sourceType": "files", "query": folder}], "outputs": outputs})
    job = engine.run(spec, mode="streaming", parameters={"timestampColumn": "t", "valueColumn": "v", "availableNow": True, **parameters})
    assert job.handle is not None, job.errors
    job.handle.awaitTermination(180)
    return engine, engine.job(job.job_id), sent


def test_a_finished_stream_counts_every_point_and_completes(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rng = random.Random(3)
    seconds = [10.0 * k + rng.uniform(0, 5) for k in range(30)]
    order = [seconds[k] for k in sorted(range(30), key=lambda k: k + rng.uniform(-6, 6))]
    batches = [[(at(s), 1.0, "a") for s in order[k : k + 6]] for k in range(0, 30, 6)]
    replay(spark, str(tmp_path / "in"), batches)
    before = spark.conf.get(stateful.PROVIDER, None)
    engine, job, _ = run(spark, str(tmp_path / "in"), [{"name": "w", "type": "table", "from": "windowState"}], windowSize="1h", allowedLateness="10m")
    assert job.status == "completed", job.errors
    last = [a.value for a in engine.artifacts.query(job.job_id)][-1]
    assert last["pointCount"] == 30 and last["sum"] == 30.0 and last["lateDropped"] == 0
    assert spark.conf.get(stateful.PROVIDER, None) == before


def test_late_counts_equal_a_plain_loop_and_silent_keys_are_released(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(round(40 * i + rng.uniform(-120, 40), 3), float(k % 5), "a") for k in range(12)] for i in range(6)]
    batches[0].append((1.0, 9.0, "b"))  # then silent: the stream's watermark releases it
    rows = [[(T0 + timedelta(seconds=t), v, k) for t, v, k in b] for b in batches]
    replay(spark, str(tmp_path / "in"), rows)
    engine, job, _ = run(spark, str(tmp_path / "in"), [{"name": "w", "type": "table", "from": "windowState"}], windowSize="1m", allowedLateness="30s", keyColumn="k")
    assert job.status == "completed", job.errors
    found = [(a.value, a.extra["batch"]) for a in engine.artifacts.query(job.job_id)]
    (window, late, _) = plain([[(t, v) for t, v, k in b if k == "a"] for b in batches], 60.0, lateness=30.0)[1]
    last = [v for v, _ in found if v["series"] == "a"][-1]
    assert (last["pointCount"], last["lateDropped"]) == (len(window), late) and late > 0
    assert any(v["series"] == "b" and v["pointCount"] == 1 and n >= 0 for v, n in found)


def test_rules_see_points_and_span_micro_batches(spark, tmp_path):
    minute = lambda m, v, k="x": (T0 + timedelta(minutes=m), v, k)
    replay(spark, str(tmp_path / "in"), [[minute(0, 1.0), minute(0.5, 50.0, "hit")], [minute(1, 31.0)], [minute(2, 30.0, "hit")]])
    condition = lambda name, c: {"name": name, "type": "alert", "from": "windowState", "parameters": {"condition": c}}
    outputs = [condition("high", "value > 40"), condition("mean", "avg(v, 5m) > 27.5"), condition("three", "count(value, 5m) >= 4"), condition("hits", 'rate(k, "hit", 10m) >= 0.2'), condition("bad", "v >")]
    engine, job, sent = run(spark, str(tmp_path / "in"), outputs, clock=lambda: datetime(2024, 1, 1, 0, 2, tzinfo=timezone.utc), windowSize="5m")
    assert job.status == "completed" and [e["code"] for e in job.errors] == ["alert.invalid_condition"]
    got = [(a["ruleId"], a["value"], a["at"] - T0.replace(tzinfo=timezone.utc).timestamp()) for a in sent]
    assert ("high", 50.0, 30.0) in got and len([g for g in got if g[0] == "high"]) == 3
    assert [g for g in got if g[0] == "mean"] == [("mean", 28.0, 120.0)]  # 25.5 and 27.3 in the micro-batches before
    assert [g for g in got if g[0] == "three"] == [("three", 4.0, 120.0)] and [g for g in got if g[0] == "hits"] == [("hits", 0.2, 120.0)]


def test_emit_interval_is_a_duration(spark, tmp_path, monkeypatch):
    replay(spark, str(tmp_path / "in"), [[(T0, 1.0, "a")]])
    seen = []
    from pyspark.sql.streaming import DataStreamWriter

    real = DataStreamWriter.trigger
    monkeypatch.setattr(DataStreamWriter, "trigger", lambda self, **k: (seen.append(k), real(self, **k))[1])
    for given in ("30s", "1h", None):
        engine = Engine(spark, SourceRegistry({"files": Files()}))
        spec = Spec.from_dict({"specId": "s", "version": "1.0.0", "inputSources": [{"sourceType": "files", "query": str(tmp_path / "in")}], "outputs": []})
        job = engine.run(spec, mode="streaming", parameters={"timestampColumn": "t", "valueColumn": "v", **({"emitInterval": given} if given else {})})
        assert engine.cancel(job.job_id).status == "canceled"
    assert [k["processingTime"] for k in seen] == ["30 seconds", "3600 seconds", "60 seconds"]
