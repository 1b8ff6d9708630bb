"""Telemetry as a data source, and facts with typed content."""

import json
from datetime import datetime, timedelta
from urllib.parse import quote

import pytest

from tidemark.errors import EngineError
from tidemark.sources.registry import FactSource, SourceRegistry, TelemetryPortSource, variant_fields

T0 = datetime(2024, 1, 1)


def spool(folder, topic, values, first=0, tail=""):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{quote(topic, safe='')}.jsonl", "a") as f:
        for k, v in enumerate(values, first):
            f.write(json.dumps({"t": (T0 + timedelta(seconds=k)).isoformat(), "v": v, "unit": "C"}) + "\n")
        f.write(tail)


def port(folder, **options):
    return TelemetryPortSource({"config": json.dumps({"folder": f"file://{folder}"}), **options})


def test_batch_drain(spark, tmp_path):
    spool(tmp_path / "s", "pump/temp", range(500), tail='{"t": "2024-')
    spool(tmp_path / "s", "pump/flow", [1.5, None])
    spool(tmp_path / "s", "fan/temp", [7.0])
    reg = SourceRegistry({"mcpIo": port(tmp_path / "s", maxPerPartition="1000")})
    rows = reg.read(spark, "mcpIo", "io://pump/temp").collect()
    assert sorted(r.value for r in rows) == list(map(float, range(500))) and {(r._deviceId, r.uri, r._unit, r._quality) for r in rows} == {("pump", "io://pump/temp", "C", "good")}
    assert reg.read(spark, "mcpIo", "io://pump/*").count() == 502 and reg.read(spark, "mcpIo", "io://*/temp").count() == 501 and reg.read(spark, "mcpIo", "io://").count() == 503
    with pytest.raises(EngineError):
        reg.read(spark, "mcpIo", "pump")
    with pytest.raises(Exception, match="source.timeout"):
        SourceRegistry({"mcpIo": port(tmp_path / "s", deadlineSeconds="0")}).read(spark, "mcpIo", "io://pump/temp").collect()
    assert port(tmp_path / "none").query(spark, "io://").count() == 0


def test_a_restarted_stream_gives_no_row_twice(spark, tmp_path):
    reg = SourceRegistry({"mcpIo": port(tmp_path / "s", maxPerPartition="700")})
    got = []

    def drain():
        stream = reg.subscribe(spark, "mcpIo", "io://pump/*")
        q = stream.writeStream.foreachBatch(lambda b, n: got.extend((r.uri, r.value) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    spool(tmp_path / "s", "pump/temp", range(100), tail='{"t": "2024-01-01T00:01:40", ')
    drain()
    assert sorted(got) == [("io://pump/temp", float(k)) for k in range(100)]
    with open(tmp_path / "s" / "pump%2Ftemp.jsonl", "a") as f:
        f.write('"v": 100.0}\n')
    spool(tmp_path / "s", "pump/temp", range(101, 150), 101)
    spool(tmp_path / "s", "pump/flow", [3.0])
    drain()
    drain()
    assert sorted(got) == [("io://pump/flow", 3.0), *(("io://pump/temp", float(k)) for k in range(150))]


@pytest.mark.parametrize("kind", ["json", "variant", "map"])
def test_facts_keep_types(spark, kind):
    rows = [("1", "t", "e1", {"n": 3, "x": 1.5, "s": "a", "ok": True}), ("2", "t", "e2", {"n": 4, "x": 2, "odd key": None, "mixed": 1}), ("3", "t", "e1", {"mixed": "one", "deep": {"a": [1]}}), ("4", "u", "e1", {"other": 1})]
    df = spark.createDataFrame([(i, t, e, json.dumps(c)) for i, t, e, c in rows], "_factId string, _factType string, _entityId string, content string")
    if kind == "variant":
        df = df.selectExpr("_factId", "_factType", "_entityId", "parse_json(content) AS content")
    if kind == "map":
        df = df.selectExpr("_factId", "_factType", "_entityId", "from_json(content, 'map<string,string>') AS content")
    got = FactSource(df).query(spark, "t")
    types = dict(got.dtypes)
    assert set(got.columns) == {"_factId", "_factType", "_entityId", "n", "x", "s", "ok", "odd key", "mixed", "deep"} and "other" not in types
    if kind != "map":
        assert (types["n"], types["x"], types["s"], types["ok"]) == ("bigint", "double", "string", "boolean")
        assert {r._factId: (r.n, r.x, r.mixed) for r in got.collect()} == {"1": (3, 1.5, None), "2": (4, 2.0, "1"), "3": (None, None, "one")}
        assert json.loads(next(r.deep for r in got.collect() if r._factId == "3")) == {"a": [1]}
    one = FactSource(df).query(spark, json.dumps({"type": "t", "entityId": "e1"}))
    assert sorted(r._factId for r in one.collect()) == ["1", "3"]


def test_facts_without_content(spark):
    df = spark.createDataFrame([("1", "t", "{}")], "_factId string, _factType string, content string")
    assert FactSource(df).query(spark, "t").columns == ["_factId", "_factType"] and FactSource(df).query(spark, "none").count() == 0
    assert variant_fields("OBJECT<a: BIGINT, b: OBJECT<c: VOID>, d: VOID, e: ARRAY<DECIMAL(2,1)>, f: DECIMAL(3,1)>") == [("a", "bigint"), ("b", "string"), ("d", "string"), ("e", "string"), ("f", "double")]
