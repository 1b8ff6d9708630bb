"""Running sums by ranges, ranks of a hot key's many values, and the Kolmogorov-Smirnov walk."""

import numpy as np
import pytest

from tidemark.functions.registry import Registry
from tidemark.functions.stats import nearest_rank
from tidemark.series import SeriesKey, running_sums

REG = Registry()


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in np.round(rng.normal(0, 50, 4000), 1)] + [("cold", 3.0), (None, 1.0), (None, 2.0)] + [("some", float(k % 7)) for k in range(50)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_running_sums(spark, values):
    rows, df = values
    counts = df.groupBy("k", "v").count()
    got = {(r.k, r.v): r.upto for r in running_sums(counts, ["k"], ["v"], {"upto": "count"}).collect()}
    assert got == {(k, v): sum(a == k and b <= v for a, b in rows) for k, v in set(rows)}
    plan = running_sums(counts, ["k"], ["v"], {"upto": "count"})._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan and plan.count("Window [") == 2 and "[_part" in plan


def test_nearest_rank_of_a_hot_key(values):
    rows, df = values
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.r): r.v for r in nearest_rank(df, ["k"], shares).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(v for a, v in rows if a == k)
        want |= {(k, i): own[int(np.floor(s * (len(own) - 1) + 0.5))] for i, s in enumerate(shares)}
    assert got == want
    own = sorted(v for _, v in rows)
    assert {r.r: r.v for r in nearest_rank(df, [], [0.5]).collect()} == {0: own[int(np.floor(0.5 * (len(own) - 1) + 0.5))]}


def test_ks_equals_a_walk(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 700), 1), np.round(rng.normal(0.2, 1.2, 500), 1)
    df = spark.createDataFrame([(float(x), float(b[i]) if i < len(b) else None) for i, x in enumerate(a)], "a double, b double").repartition(4)
    got = REG.run("hypothesis_test", df, SeriesKey.of("a"), {"test": "ks", "columns": ["a", "b"]}).scalars.first()
    x, y, i, j, d = sorted(a), sorted(b), 0, 0, 0.0
    while i < len(x) and j < len(y):
        if x[i] <= y[j]:
            i += 1
        else:
            j += 1
        d = max(d, abs(i / len(x) - j / len(y)))
    assert got.statistic == pytest.approx(d)


@pytest.mark.parametrize("method", ["mad", "iqr"])
def test_anomalies_of_many_series(spark, values, method):
    """Keyed medians and quartiles give what each series gives alone."""
    rows, _ = values
    rows = [(k or "none", i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    keyed = REG.run("anomaly_detect", df, SeriesKey.of("i", "k"), {"column": "v", "method": method, "sensitivity": 1.0}).series["anomalies"][0]
    got = {k: sorted((r.idx, r.value, round(r.score, 9)) for r in keyed.collect() if r.k == k) for k in ("hot", "some")}
    for k, found in got.items():
        one = REG.run("anomaly_detect", df.where(df.k == k), SeriesKey.of("i"), {"column": "v", "method": method, "sensitivity": 1.0}).series["anomalies"][0]
        assert found == sorted((r.idx, r.value, round(r.score, 9)) for r in one.collect()) and (found or k == "some")
