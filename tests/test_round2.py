"""Order statistics, window ranges, declared results, errors of lazy results, streams with transforms and point rules."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import series
from tidemark.errors import EngineError
from tidemark.functions.registry import BUILT_IN, Registry
from tidemark.functions.stats import order_statistics
from tidemark.plans.engine import Engine
from tidemark.plans.model import Spec
from tidemark.series import SeriesKey
from tidemark.sources.registry import SourceRegistry, SyntheticSource, UploadSource
from tidemark.streaming import windows


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "skew"])
def test_order_statistics(spark, kind):
    rng = np.random.default_rng(1)
    x = {"spread": rng.normal(size=30_000), "ties": rng.integers(0, 4, 30_000).astype(float), "few": np.array([3.0, 1.0, 2.0]), "skew": np.concatenate([np.zeros(20_000), rng.pareto(1, 10_000)])}[kind]
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "v double, w double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = order_statistics(df, ["v", "w"], shares, lambda s, n: math.floor(s * (n - 1) + 0.5))
    ranked = np.sort(x)
    assert got == {"v": [ranked[math.floor(s * (len(x) - 1) + 0.5)] for s in shares], "w": [None] * 5}


def test_sliding_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    t0 = datetime(2024, 1, 1)
    rows = [(int(k % 3), t0 + timedelta(seconds=int(s)), v) for k, (s, v) in enumerate(zip(rng.integers(0, 4000, 400), rng.normal(1e6, 1, 400).tolist()))]
    rows += [(0, t0 + timedelta(seconds=5), None), (1, t0, float("nan")), (2, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, t timestamp, v double").repartition(7)
    got = windows.sliding(df, "t", "v", "1m", list(windows.AGGREGATES), ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.t is None:
            assert r["avg"] is None and r["max"] is None
            continue
        own = [v if v is not None else 0.0 for g, t, v in rows if g == r.g and t is not None and r.t - timedelta(seconds=60) <= t <= r.t]
        if any(math.isnan(v) for v in own):
            assert math.isnan(r["sum"]) and math.isnan(r["max"])
            continue
        want = (np.mean(own), min(own), max(own), sum(own), len(own), np.std(own, ddof=1) if len(own) > 1 else 0.0)
        assert np.allclose([r["avg"], r["min"], r["max"], r["sum"], r["count"], r["std"]], want, rtol=1e-9, atol=1e-5)
    assert windows.sliding(df.limit(0), "t", "v", "1m", ["avg"]).count() == 0


PARAMS = {
    "anomaly_detect": {"column": "v", "method": "zscore"}, "event_analysis": {"eventColumn": "e", "timestampColumn": "t", "metrics": ["frequency", "mtbf", "mttr", "transitions"]}, "time_series_analysis": {"column": "v"},
    "correlation_regression": {"xColumn": "v", "yColumn": "w"}, "rule_based_classification": {"rules": [{"column": "v", "operator": ">", "value": 0, "label": "up"}]}, "seasonality_analysis": {"column": "v", "period": 8},
    "psd_welch": {"column": "v", "sampleRate": 64.0, "segmentLength": 32, "bands": [{"name": "low", "low": 0, "high": 8}]}, "digital_filter": {"column": "v", "sampleRate": 64.0, "cutoff": 8.0},
    "zero_crossing": {"column": "v", "sampleRate": 64.0}, "resample": {"column": "v", "sourceRate": 64.0, "factor": 2}, "regression": {"columns": ["v", "w"]}, "histogram": {"column": "v"},
    "lockin": {"column": "v", "sampleRate": 64.0, "referenceFrequency": 8.0}, "lomb_scargle": {"columns": ["s", "v"]}, "covariance_matrix": {"columns": ["v", "w"]}, "pca": {"columns": ["v", "w"]}, "hrv_metrics": {"column": "w"},
}
#: Alternatives of one function: what another method of it makes.
OTHER = {"time_series_analysis": {"slope", "intercept"}, "hypothesis_test": {"criticalValue"}, "anomaly_detect": set()}


def test_declared_results_are_made(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=k), float(k), math.sin(k * math.pi / 4) + 0.01 * k % 1, 800.0 + (k * 37) % 60, ["error", "recovered", "view"][k % 3]) for k in range(128)]
    df = spark.createDataFrame(rows, "t timestamp, s double, v double, w double, e string")
    registry, missing = Registry(), {}
    for info in BUILT_IN:
        params = PARAMS.get(info.name, {"column": "v", "columns": ["v", "w"], "sampleRate": 64.0})
        if info.name == "interpolate" or "columns" not in (*info.required, *info.optional):
            params = {k: v for k, v in params.items() if k != "columns"}
        got = registry.run(info.name, df, SeriesKey.of("t"), params)
        made = {*got.plain, *got.series, *(got.scalars.columns if got.scalars is not None else ())}
        lacking = set(info.results) - made - OTHER.get(info.name, set())
        if lacking:
            missing[info.name] = sorted(lacking)
    assert not missing


def test_partition_keys_are_refused_where_a_result_is_one(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "g int, v double, w double")
    for name in ("histogram", "regression", "hypothesis_test", "pca", "acf", "cross_correlation", "lomb_scargle"):
        with pytest.raises(EngineError) as e:
            Registry().run(name, df, SeriesKey.of("v", "g"), {"columns": ["v", "w"], "column": "v"})
        assert "one series" in e.value.message


def test_an_error_of_a_lazy_result_ends_the_job(spark):
    seen = []
    engine = Engine(spark, SourceRegistry({"upload": UploadSource()}), metrics=lambda n, v: seen.append(n))
    job = engine.run(engine.create_spec({
        "specId": "one", "version": "1.0.0", "inputSources": [{"sourceType": "upload", "query": "t,v\n1,2\n"}],
        "analysisSteps": [{"id": "f", "function": "fft", "parameters": {"column": "v", "sampleRate": 10.0}}], "outputs": [{"name": "d", "type": "metric", "from": "f", "field": "dominantFrequency"}],
    }))
    assert job.status == "failed" and job.errors[-1]["code"] == "analysis.execution_error" and "analysis.failure_rate" in seen


def test_a_matrix_is_a_list_of_rows(spark):
    engine = Engine(spark, SourceRegistry({"upload": UploadSource()}))
    job = engine.run(engine.create_spec({
        "specId": "m", "version": "1.0.0", "inputSources": [{"sourceType": "upload", "query": "t,v,w\n1,2,5\n2,4,1\n3,9,7\n"}],
        "analysisSteps": [{"id": "c", "function": "covariance_matrix", "parameters": {"columns": ["v", "w"]}}, {"id": "p", "function": "pca", "parameters": {"columns": ["v", "w"]}}, {"id": "k", "function": "rule_based_classification", "parameters": {"rules": []}}],
        "outputs": [{"name": "c", "type": "table", "from": "c", "field": "covariance"}, {"name": "s", "type": "series", "from": "p", "field": "scores"}, {"name": "n", "type": "metric", "from": "k", "field": "totalRows"}],
    }))
    assert job.status == "completed", job.errors
    got = {a.name: a.value for a in engine.artifacts.query(job.job_id)}
    assert np.allclose(got["c"], np.cov([[2, 4, 9], [5, 1, 7]])) and len(got["s"]) == 3 and len(got["s"][0]) == 2 and got["n"] == 3


def test_streams_transform_and_watch_points(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=k), 500.0 if k == 7 else -5.0 if k % 2 else 10.0) for k in range(20)]
    spark.createDataFrame(rows, "t timestamp, v double").write.parquet(str(tmp_path / "in"))

    class Files:
        def query(self, spark, query, filter=None, time_range=None):
            return spark.readStream.schema("t timestamp, v double").parquet(query)

    sent = []
    engine = Engine(spark, SourceRegistry({"files": Files()}))
    engine.publisher.publish = lambda topic, payload: sent.append((payload["ruleId"], payload["value"]))
    job = engine.run(Spec.from_dict({
        "specId": "s", "version": "1.0.0", "inputSources": [{"sourceType": "files", "query": str(tmp_path / "in")}], "transforms": [{"name": "filter", "parameters": {"column": "v", "operator": ">", "value": 0}}],
        "outputs": [{"name": "w", "type": "table", "from": "windowState"}, {"name": "high", "type": "alert", "from": "windowState", "parameters": {"condition": "v > 400"}}, {"name": "mean", "type": "alert", "from": "windowState", "parameters": {"condition": "value > 1000"}}],
    }), mode="streaming", parameters={"timestampColumn": "t", "valueColumn": "v", "windowSize": "1m", "availableNow": True})
    job.handle.awaitTermination(120)
    assert engine.job(job.job_id).status == "completed"
    state = [a.value for a in engine.artifacts.query(job.job_id) if a.name == "w"][-1]
    assert state["pointCount"] == 11 and state["min"] == 10.0 and sent == [("high", 500.0)]


def test_intermediate_tables_need_a_shared_folder(spark):
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return "spark://host:7077" if name == "spark.master" else None

    with pytest.raises(ValueError):
        series.shared_dir(Session)
