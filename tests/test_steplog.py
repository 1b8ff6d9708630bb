"""Step logs and throughput by observation; chart series, time points, model parameters."""

from datetime import datetime, timedelta, timezone

import pytest

from tidemark.functions.base import Result
from tidemark.operators.steplog import StepLog
from tidemark.operators.transforms import TransformPipeline
from tidemark.plans.engine import Engine, series_points
from tidemark.plans.model import Job, OutputDef, Spec
from tidemark.sources.registry import SourceRegistry, UploadSource

CSV = "t,v\n" + "\n".join(f"{k},{k % 10}" for k in range(100)) + "\n"


def test_rows_of_each_step_without_another_job(spark):
    df = spark.range(1000).selectExpr("id AS t", "cast(id % 10 AS double) AS v")
    log = StepLog()
    out = TransformPipeline().run(log.watch(df, "input"), [("filter", {"column": "v", "operator": ">", "value": 5}), ("clip", {"column": "v", "min": 0, "max": 7})], None, log)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("steps", "steps")
    assert out.count() == 400
    before = len(tracker.getJobIdsForGroup("steps"))
    assert [(e["step"], e["rowsIn"], e["rowsOut"]) for e in log.entries()] == [("input", None, 1000), ("transform:filter", 1000, 400), ("transform:clip", 400, 400)]
    assert len(tracker.getJobIdsForGroup("steps")) == before
    assert StepLog().entries() == []


@pytest.mark.parametrize("alerts", [False, True])
def test_engine_logs_steps_and_throughput(spark, alerts):
    seen = {}
    engine = Engine(spark, SourceRegistry({"upload": UploadSource()}), metrics=seen.__setitem__, step_log=True)
    outputs = [{"name": "m", "type": "metric", "from": "d", "field": "mean"}] + [{"name": "high", "type": "alert", "from": "d", "parameters": {"condition": "v > 8"}}] * alerts
    job = engine.run(Spec.from_dict({
        "specId": "s", "version": "1.0.0", "inputSources": [{"sourceType": "upload", "query": CSV}], "transforms": [{"name": "filter", "parameters": {"column": "v", "operator": ">", "value": 4}}],
        "analysisSteps": [{"id": "d", "function": "descriptive_stats", "parameters": {"columns": ["v"]}}], "outputs": outputs,
    }))
    assert job.status == "completed", job.errors
    assert "transform:filter: 100 -> 50 rows, columns t, v" in job.logs and seen["analysis.throughput"] > 0


def test_time_points(spark):
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda points: [(p["t"] - epoch) / timedelta(microseconds=1) for p in points]
    assert at(series_points([1, 2, 3], None)) == [0, 1, 2] and at(series_points([1, 2, 3], [5, 5, 5])) == [0, 1, 2]
    assert at(series_points([1, 2, 3], [10, 20, 50])) == [0, 250_000_000, 1_000_000_000]
    assert series_points([4], [datetime(2024, 1, 1)]) == [{"t": datetime(2024, 1, 1), "v": 4.0}] and series_points("no", None) == []
    frame = series_points(spark.range(5).selectExpr("id AS idx", "cast(id AS double) AS v"), None)
    assert [r.t.replace(tzinfo=timezone.utc) for r in frame.orderBy("v").collect()][-1] == epoch + timedelta(seconds=1000)


def test_charts_have_series_and_models_parameters(spark):
    engine = Engine(spark, SourceRegistry({}))
    spec = Spec.from_dict({"specId": "s", "version": "2.0.0", "inputSources": [], "outputs": []})
    job = Job("j", "s", "2.0.0", "batch")
    frame = spark.createDataFrame([(0, 1.0, 10.0), (1, 4.0, 30.0)], "idx long, y double, f double")
    results = {"r": Result(series={"values": (frame, "y"), "f": (frame, "f")}, plain={"fit": {"parameters": {"a": 1}, "modelVersion": "7", "performanceMetrics": {"r2": 0.5}}})}
    chart = engine._artifact(spec, job, OutputDef("c", "chart", "r", field="values", index_field="f"), results)
    assert chart.extra["series"][0]["name"] == "values" and [p["v"] for p in chart.extra["series"][0]["points"]] == [1.0, 4.0] and chart.extra["xAxis"]["label"] == "f"
    model = engine._artifact(spec, job, OutputDef("m", "model", "r", field="fit"), results)
    assert model.value == {"a": 1} and model.extra == {"modelVersion": "7", "performanceMetrics": {"r2": 0.5}}
