"""Plug-ins, streaming sources, availability, kept artifacts and audit entries, chart axes."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.functions.base import Result
from tidemark.functions.registry import Registry
from tidemark.plans.engine import Engine
from tidemark.plans.plugins import Manifest, PluginLoader
from tidemark.plans.store import ArtifactStore, KeyValueStore
from tidemark.series import SeriesKey
from tidemark.sources.registry import SourceRegistry, SyntheticSource, UploadSource


def total(df, key, params):
    return Result(scalars=df.agg(F.sum(params["column"]).alias("total")))


def test_plugins(spark):
    registry = Registry()
    loader = PluginLoader(registry, "1.4.0", timeout=2)
    for bad, code in ((Manifest(""), "invalid_manifest"), (Manifest("total"), "invalid_manifest"), (Manifest("total", "^2.0.0"), "incompatible_version"), (Manifest("total", "^x"), "incompatible_version")):
        with pytest.raises(EngineError) as e:
            loader.load(bad, total)
        assert e.value.code == f"plugin.{code}"
    with pytest.raises(EngineError) as e:
        loader.load(Manifest("fft", "^1.0.0"), total)
    assert e.value.code == "analysis.duplicate_function" and not loader.is_plugin("fft")
    loader.load(Manifest("total", ">=1.0.0 <2.0.0", required=("column",), results=("total",)), total)
    df = spark.createDataFrame([(1, 2.0), (2, 5.0)], "t int, v double")
    assert registry.run("total", df, SeriesKey.of("t"), {"column": "v"}).scalars.first()[0] == 7.0
    with pytest.raises(EngineError) as e:
        registry.run("total", df, SeriesKey.of("t"), {})
    assert e.value.code == "analysis.parameter_error"
    loader.unload("fft")
    loader.unload("total")
    assert "fft" in registry.by_name and "total" not in registry.by_name and not loader.is_plugin("total")


def test_a_plugin_that_fails_or_takes_too_long(spark):
    registry = Registry()
    loader = PluginLoader(registry, timeout=1)
    loader.load(Manifest("wrong", "^1.0.0"), lambda df, key, params: 1 / 0)
    loader.load(Manifest("slow", "^1.0.0"), lambda df, key, params: time.sleep(3))
    df = spark.createDataFrame([(1, 2.0)], "t int, v double")
    for name, code in (("wrong", "plugin.execution_error"), ("slow", "analysis.execution_error")):
        with pytest.raises(EngineError) as e:
            registry.run(name, df, SeriesKey.of("t"), {})
        assert e.value.code == code


def test_synthetic_streams_give_the_rows_of_the_batch(spark):
    query = {"samples": 70, "sampleRate": 10.0, "seed": 4, "batchSize": 50, "components": [{"kind": "sine", "frequency": 1.5}, {"kind": "noise", "std": 0.2}]}
    sources = SourceRegistry({"synthetic": SyntheticSource(), "upload": UploadSource()})
    want = [tuple(r) for r in sources.read(spark, "synthetic", json.dumps(query)).orderBy("_timestamp").collect()]
    made = sources.subscribe(spark, "synthetic", json.dumps(query))
    handle = made.writeStream.format("memory").queryName("synthetic_rows").trigger(processingTime="0 seconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("synthetic_rows").count() < 70:
            time.sleep(0.2)
    finally:
        handle.stop()
    assert [tuple(r) for r in spark.table("synthetic_rows").orderBy("_timestamp").collect()] == want
    for kind, text in (("upload", "a\n1\n"), ("none", "")):
        with pytest.raises(EngineError) as e:
            sources.subscribe(spark, kind, text)
        assert e.value.code == "source.unavailable"
    with pytest.raises(EngineError) as e:
        sources.subscribe(spark, "synthetic", '{"components": [{"kind": "rlc"}]}')
    assert e.value.code == "source.schema_mismatch"


def test_sources_say_whether_they_answer(spark):
    class Down(UploadSource):
        def available(self):
            return False

    sources = SourceRegistry({"upload": UploadSource(), "down": Down()})
    assert sources.types() == ["upload", "down"] and sources.available("upload") and not sources.available("down") and not sources.available("none")
    assert sources.schema(spark, "upload", "a,b\n1,x\n").fieldNames() == ["a", "b"]
    with pytest.raises(EngineError) as e:
        sources.read(spark, "down", "a\n1\n")
    assert e.value.code == "source.unavailable"
    sources.unregister("down")
    assert sources.types() == ["upload"]


def test_kept_artifacts_audit_and_chart_axes(spark):
    disk = {}
    engine = Engine(spark, SourceRegistry({"upload": UploadSource()}))
    engine.artifacts = ArtifactStore(KeyValueStore("artifacts", disk.get, disk.__setitem__))
    spec = engine.create_spec({
        "specId": "k", "version": "1.0.0", "inputSources": [{"sourceType": "upload", "query": "t,v\n1,2\n2,4\n3,9\n"}], "analysisSteps": [{"id": "d", "function": "differencing", "parameters": {"column": "v"}}],
        "outputs": [{"name": "c", "type": "chart", "from": "d", "field": "values"}],
    })
    job = engine.run(spec)
    assert job.status == "completed", job.errors
    (made,) = engine.artifacts.query(job.job_id)
    assert made.extra["yAxis"] == {"label": "values", "type": "linear"} and made.extra["xAxis"]["label"] == "index"
    assert json.loads(disk[f"artifacts:{made.artifact_id}"])["value"] == [2.0, 5.0]

    def full(*_):
        raise OSError("full")

    engine.artifacts = ArtifactStore(KeyValueStore("artifacts", disk.get, full))
    assert engine.run(spec).errors[-1]["code"] == "artifact.store_failed"
    engine.audit.sink = full
    with pytest.raises(EngineError) as e:
        engine.run(spec)
    assert e.value.code == "governance.audit_failed" and not any(j.status == "running" for j in engine.jobs.values())
