import json
import math
import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest

from tidemark.errors import EngineError
from tidemark.functions.base import Result
from tidemark.plans.engine import Engine
from tidemark.plans.facade import Facade
from tidemark.plans.governance import Policy, compatible
from tidemark.plans.model import OutputDef, Spec, validate
from tidemark.sources.registry import ApiSource, SourceRegistry, SyntheticSource, UploadSource, extract, safe_details, with_retry
from tidemark.sources.synthetic import generate
from tidemark.streaming import windows
from tidemark.streaming.alerts import Rule, evaluate_frame, parse

TONE = json.dumps({"samples": 1024, "sampleRate": 1000.0, "components": [{"kind": "sine", "amplitude": 3.0, "frequency": 125.0}]})


def spec(**over):
    base = {
        "specId": "tone", "version": "1.0.0", "inputSources": [{"sourceType": "synthetic", "query": TONE}],
        "analysisSteps": [
            {"id": "spectrum", "function": "fft", "parameters": {"column": "value", "sampleRate": 1000.0, "window": "rect"}},
            {"id": "peaks", "function": "peak_detect", "parameters": {"column": "magnitude", "minHeight": 1.0}, "input": {"from": "spectrum", "field": "magnitudes", "column": "magnitude", "indexField": "frequencies", "indexColumn": "frequency"}},
        ],
        "outputs": [
            {"name": "dominant", "type": "metric", "from": "spectrum", "field": "dominantFrequency"}, {"name": "bins", "type": "series", "from": "peaks", "field": "indices"},
            {"name": "level", "type": "alert", "from": "spectrum", "parameters": {"condition": "max(value, 1h) > 2", "severity": "critical", "actionHook": "form:call"}},
        ],
    }
    return base | over


@pytest.fixture
def engine(spark):
    return Engine(spark, SourceRegistry({"synthetic": SyntheticSource(), "upload": UploadSource()}))


def test_a_spec_runs_through(engine):
    sent = []
    engine.publisher.publish = lambda topic, payload: sent.append(topic)
    job = engine.run(engine.create_spec(spec()))
    assert job.status == "completed", job.errors
    got = {a.name: a.value for a in engine.artifacts.query(job.job_id)}
    assert got["dominant"] == 125.0 and got["bins"] == [128] and got["level"]["triggered"]
    assert sent == ["analysis.alert", "analysis.alert.form"]
    alert = engine.artifacts.query(job.job_id, kind="alert")[0]
    assert engine.evaluate_alert(alert.artifact_id)["triggered"]


def test_validation_codes():
    codes = lambda **o: {i.code.removeprefix("spec.invalid.") for i in validate(Spec.from_dict(spec(**o)))}
    assert codes() == set()
    assert codes(specId="a b", version="1") == {"bad_spec_id", "bad_version"}
    assert "missing_field" in codes(inputSources=[], outputs=[])
    assert codes(analysisSteps=[{"function": "fft"}, {"function": "fft"}], outputs=[{"name": "fft"}]) == {"duplicate_step_key"}
    assert codes(outputs=[{"name": "x", "from": "nope"}]) == {"unresolved_output_source"}
    assert codes(transforms=[{"name": ""}]) == {"empty_transform"}
    steps = spec()["analysisSteps"]
    assert "step_input_order" in codes(analysisSteps=steps[::-1])


def test_unknown_function_and_failed_source(engine):
    with pytest.raises(EngineError) as e:
        engine.create_spec(spec(analysisSteps=[{"id": "spectrum", "function": "nope"}]))
    assert e.value.code == "spec.invalid"
    s = engine.create_spec(spec(specId="two", inputSources=[{"sourceType": "upload", "query": "a,b\n1\n"}, {"sourceType": "synthetic", "query": TONE}]))
    job = engine.run(s)
    assert job.status == "completed" and job.errors[0]["code"] == "source.schema_mismatch"
    assert engine.run(s, mode="adhoc").status == "failed"


def test_upload(spark):
    up = UploadSource()
    rows = up.query(spark, 'a;b\n1;"x;y"\n\n2;"line\nbreak ""q"""\n').collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x;y"), (2, 'line\nbreak "q"')]
    assert up.query(spark, '[{"a": 1, "b": {"c": 2}}, 5, {"a": 3}]').count() == 2
    for bad in ("a,b\n1\n", "a,b\n1,2,3\n", '[{"a": 1'):
        with pytest.raises(EngineError):
            up.query(spark, bad).count()


def test_api(spark):
    config = {"url": "https://u:p@h.example/x?key=1", "headers": {"Authorization": "secret"}, "dataArrayPath": "data.items", "responseMapping": {"v": "a.b", "first": "list[].n"}}
    body = json.dumps({"data": {"items": [{"a": {"b": 1}, "list": [{"n": 7}, {"n": 8}]}]}})
    assert ApiSource(lambda c: (200, body)).query(spark, json.dumps(config)).first().asDict() == {"v": 1, "first": 7}
    for status, code in ((401, "source.unauthorized"), (500, "source.unavailable")):
        with pytest.raises(EngineError) as e:
            ApiSource(lambda c, s=status: (s, "")).query(spark, json.dumps(config))
        assert e.value.code == code and "secret" not in str(e.value.details) and "p@" not in str(e.value.details)
    assert extract({"a": {"b": 2}}, "a.c") is None and safe_details(config)["queryNames"] == ["key"]


def test_retry():
    calls, waits = [], []

    def fail():
        calls.append(1)
        raise EngineError("source.timeout", "slow")

    with pytest.raises(EngineError) as e:
        with_retry(fail, sleep=waits.append)
    assert e.value.code == "job.retry_exhausted" and len(calls) == 4 and waits == [1, 2, 4]


def test_synthetic_systems(spark):
    y = [r.value for r in generate(spark, {"samples": 600, "sampleRate": 100.0, "components": [{"kind": "transfer_function", "num": [1], "den": [1, 1]}]}).orderBy("_timestamp").collect()]
    assert y[100] == pytest.approx(1 - math.exp(-1), abs=0.01)
    same = {"samples": 50, "seed": 5, "components": [{"kind": "noise"}]}
    a, b = (sorted(r.value for r in generate(spark, same).repartition(n).collect()) for n in (1, 7))
    assert a == b
    with pytest.raises(EngineError):
        generate(spark, {"samples": 0})


def test_conditions():
    assert parse("avg(v, 5m) > 75").kind == "window" and parse('rate(e, "x y", 1h) >= 2').match == "x y" and parse("v <= 3").threshold == 3
    for bad in ("v", "v > x", "avg(v, 5m) > y"):
        with pytest.raises(EngineError):
            parse(bad)


def test_alert_rules_share_one_query(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(minutes=i), float(i), "e" if i % 2 else "f") for i in range(60)], "_timestamp timestamp, v double, k string")
    rules = [Rule("a", "v > 57"), Rule("b", "avg(v, 10m) > 54"), Rule("c", 'rate(k, "e", 10m) > 0.4'), Rule("d", "v >"), Rule("e", "v > 99")]
    got = {r.ruleId: (r.triggered, r.value) for r in evaluate_frame(df, rules, ["_timestamp"], datetime(2024, 1, 1, 1, tzinfo=timezone.utc)).collect()}
    assert got == {"a": (True, 58.0), "b": (False, 54.0), "c": (True, 0.5), "d": (False, None), "e": (False, 59.0)}


def test_stream_equals_batch(spark, tmp_path, engine):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=10 * i), float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "_timestamp timestamp, value double").coalesce(1)
    df.orderBy("_timestamp").write.parquet(str(tmp_path / "in"))

    class Replay:
        def query(self, spark, query):
            return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    engine.sources.register("mcpIo", Replay())
    s = engine.create_spec(spec(specId="live", inputSources=[{"sourceType": "mcpIo"}], parameters={"windowSize": "5m", "availableNow": True, "checkpointLocation": str(tmp_path / "ck")}, outputs=[{"name": "pointCount", "type": "metric"}]))
    job = engine.run(s, mode="streaming")
    job.handle.awaitTermination(120)
    assert engine.artifacts.query(job.job_id)[-1].value == 31
    batch = windows.sliding(df, "_timestamp", "value", "5m", ["count"]).orderBy("_timestamp").collect()[-1]
    assert batch["count"] == 31


def test_whole_results_beyond_the_bound_keep_their_frame(spark, engine, monkeypatch):
    """1,200 rows are all there: as rows up to the bound, as the frame beyond it; neither stops at 1,000."""
    result = Result(scalars=spark.range(1200), plain={"n": 1})
    assert sorted(r["id"] for r in engine._value(result, None)["rows"]) == list(range(1200))
    monkeypatch.setattr("tidemark.plans.engine.SERIES_VALUES", 1000)
    out = OutputDef("all", "summary", "r")
    got = engine._artifact(engine.create_spec(spec(specId="rows")), SimpleNamespace(job_id="j", errors=[]), out, {"r": result})
    assert got.value["n"] == 1 and got.value["rows"].count() == 1200


@pytest.mark.parametrize("bound", [100_000, 1000])
def test_stream_keeps_every_key(spark, tmp_path, engine, monkeypatch, bound):
    """Each of a batch's 1,100 keys is found in the artifacts, one by one or in the batch's table."""
    monkeypatch.setattr("tidemark.plans.engine.SERIES_VALUES", bound)
    df = spark.createDataFrame([(datetime(2024, 1, 1), f"k{i}", 1.0) for i in range(1100)], "_timestamp timestamp, who string, value double").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))

    class Replay:
        def query(self, spark, query):
            return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    engine.sources.register("mcpIo", Replay())
    s = engine.create_spec(spec(specId="keys", inputSources=[{"sourceType": "mcpIo"}], parameters={"windowSize": "5m", "availableNow": True, "keyColumn": "who", "checkpointLocation": str(tmp_path / "ck")}, outputs=[{"name": "pointCount", "type": "metric"}]))
    job = engine.run(s, mode="streaming")
    job.handle.awaitTermination(120)
    found = engine.artifacts.query(job.job_id)
    assert len(found) == 1100 if bound > 1000 else [a.value.count() for a in found] == [1100]


def test_governance_and_facade(engine):
    p = Policy()
    p.check("x", "operator", "create_spec", groups=["Engineers"])
    with pytest.raises(EngineError):
        p.check("x", "operator", "create_spec")
    assert compatible("^1.2.0", "1.9.1") and not compatible("^1.2.0", "2.0.0") and compatible(">=1.0.0 <2.0.0", "1.5.0")
    f = Facade(engine)
    assert f.call("analysis.create_spec", {"spec": spec()}, role="engineer") == {"specId": "tone", "version": "1.0.0"}
    assert f.call("analysis.create_spec", {"spec": spec()}, role="operator")["error"]["code"] == "governance.unauthorized"
    assert f.call("analysis.nope", {})["error"]["code"] == "mcp.unknown_tool"
    assert f.call("analysis.run", {})["error"]["code"] == "mcp.invalid_arguments"
    job = f.call("analysis.run", {"specId": "tone"})
    assert job["status"] == "completed" and f.resource(f"analysis:///job/{job['jobId']}")["status"] == "completed"
    assert len(f.resource("analysis:///catalog")["functions"]) == 36
    for uri, code in (("x://a", "mcp.invalid_uri"), ("analysis:///zzz/1", "mcp.unknown_resource")):
        with pytest.raises(EngineError) as e:
            f.resource(uri)
        assert e.value.code == code
