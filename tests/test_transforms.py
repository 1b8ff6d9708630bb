from datetime import datetime, timedelta

import pytest

from tidemark.errors import EngineError
from tidemark.operators import merge
from tidemark.operators.asof import asof_join
from tidemark.operators.transforms import UNITS, TransformPipeline, fillna
from tidemark.series import SeriesKey, carried, over_rows, with_index
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
KEY = SeriesKey.of("t")
PIPE = TransformPipeline()


def at(m):
    return T0 + timedelta(minutes=m)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(at(0), 71.0, "active"), (at(1), 73.5, "active"), (at(2), None, "active"), (at(3), 95.0, "inactive"), (at(4), 72.0, "active")], "t timestamp, temperature double, status string")


def values(df, c="temperature"):
    return [r[c] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("op,value,n", [("==", "active", 4), ("!=", "active", 1), ("in", ["inactive", "x"], 1), ("notIn", ["inactive"], 4), ("isNull", None, 0), ("isNotNull", None, 5), ("~", 1, 0), ("==", 1, 0), (">", "a", 0)])
def test_filter_on_text(rows, op, value, n):
    assert PIPE.run(rows, [("filter", {"column": "status", "operator": op, "value": value})]).count() == n


@pytest.mark.parametrize("op,value,n", [(">", 72, 2), (">=", "72", 3), ("<", 72, 1), ("<=", 72.0, 2), ("!=", 72, 3), ("isNull", None, 1), ("==", "72", 0)])
def test_filter_on_numbers_drops_nulls(rows, op, value, n):
    assert PIPE.run(rows, [("filter", {"column": "temperature", "operator": op, "value": value})]).count() == n


def test_errors_have_codes(rows):
    for step, code in [(("nope", {}), "transform.unknown"), (("filter", {}), "transform.parameter_error"), (("sort", {}), "transform.parameter_error"), (("clip", {"column": "status"}), "transform.schema_error")]:
        with pytest.raises(EngineError) as e:
            PIPE.run(rows, [step])
        assert e.value.code == code


@pytest.mark.parametrize("params,want", [({"method": "value", "value": 0.0}, 0.0), ({"method": "forward"}, 73.5), ({"method": "backward"}, 95.0), ({"method": "interpolate"}, 84.25)])
def test_fillna(rows, params, want):
    assert values(fillna(rows, {"column": "temperature", **params}, KEY))[2] == want


def test_interpolate_halves_towards_the_next_value(spark):
    v = [None, 1.0, None, None, 9.0, None]
    df = spark.createDataFrame([(at(i), x) for i, x in enumerate(v)], "t timestamp, temperature double")
    assert values(fillna(df, {"column": "temperature", "method": "interpolate"}, KEY)) == [1.0, 1.0, 5.0, 7.0, 9.0, 9.0]


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(at(0), float("nan")), (at(1), None), (at(2), 5.0), (at(3), -5.0)], "t timestamp, temperature double")
    got = values(PIPE.run(df, [("clip", {"column": "temperature", "min": 0, "max": 1})]))
    assert got[0] != got[0] and got[1:] == [None, 1.0, 0.0]


def test_units(rows):
    assert len(UNITS) == 16
    out = PIPE.run(rows, [("unit_convert", {"column": "temperature", "from": "F", "to": "C"})])
    assert values(out)[3] == pytest.approx(35.0) and out.schema["temperature"].metadata == {"unit": "C"}
    same = PIPE.run(rows, [("unit_convert", {"column": "temperature", "from": "F", "to": "parsec"})])
    assert values(same)[3] == 95.0


def test_resample(rows):
    out = PIPE.run(rows, [("resample", {"interval": "2m", "aggregation": "mean"})])
    assert values(out) == [72.25, 95.0, 72.0] and out.columns == ["t", "temperature"]
    assert values(PIPE.run(rows.where("temperature is null"), [("resample", {"interval": "2m", "aggregation": "count"})])) == [None]


def test_asof(spark):
    left = spark.createDataFrame([(at(0), "a"), (at(2), "b"), (at(5), "c"), (None, "d")], "_timestamp timestamp, sensor string")
    right = spark.createDataFrame([(at(1), 1013.0, 1), (at(4), 1015.0, 2), (at(4), 1016.0, 3), (None, 1.0, 4)], "_timestamp timestamp, pressure double, k long")
    pick = lambda m: {r.sensor: r.pressure for r in asof_join(left, right, method=m, right_order="k").collect()}
    assert pick("nearest") == {"a": 1013.0, "b": 1013.0, "c": 1015.0, "d": None}
    assert pick("backward") == {"a": None, "b": 1013.0, "c": 1016.0, "d": None}
    assert pick("forward") == {"a": 1013.0, "b": 1015.0, "c": None, "d": None}
    assert pick("exact") == {"a": None, "b": None, "c": None, "d": None}


def test_merge(spark):
    a = spark.createDataFrame([(at(i), float(i)) for i in range(5)], "_timestamp timestamp, value double")
    b = spark.createDataFrame([(at(0), 10.0), (at(2), 20.0), (at(4), 30.0)], "_timestamp timestamp, value double")
    joined = merge.align(a, merge.alias_columns(b, {"value": "slow"}))
    assert [r.slow for r in joined.orderBy("_timestamp").collect()] == [10.0, 10.0, 20.0, 20.0, 30.0]
    with pytest.raises(EngineError) as e:
        merge.align(a, b)
    assert e.value.code == "source.column_collision"
    assert merge.append([a, b.drop("value")]).count() == 8


def test_index_carry_and_windows_do_not_depend_on_layout(spark):
    n = 500
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k")).withColumn("v", F.when(F.col("k") % 5 == 0, F.col("k").cast("double")))
    key = SeriesKey.of("k")
    for parts in (1, 7):
        i = with_index(df.repartition(parts), key)
        assert i.where("idx <> k").count() == 0
        got = carried(i, key, {"f": F.col("v")}, chunk=37)
        assert got.where("f <> k - k % 5").count() == 0 and got.count() == n
        back = carried(i, key, {"f": F.col("v")}, backward=True, chunk=37)
        assert back.where("k <= 495 and f <> ceil(k / 5) * 5").count() == 0
        w = over_rows(i, key, 3, 2, {"s": lambda w: F.sum("k").over(w.rowsBetween(-3, 2))}, chunk=20)
        rows = {r.k: r.s for r in w.collect()}
        assert all(rows[k] == sum(range(max(0, k - 3), min(n, k + 3))) for k in range(n))
