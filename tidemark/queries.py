"""Registered queries: each operator on the tables, with DuckDB SQL for the same rows.

Real numbers are rounded to six decimals on both sides, after a small shift: means of
decimal values fall on exact halves of the last digit, where sums in another order
round apart.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.registry import Registry
from .operators import merge
from .operators.asof import asof_join
from .operators.transforms import TransformPipeline
from .series import INDEX, SeriesKey
from .sources import synthetic
from .streaming import windows
from .streaming.alerts import Rule, evaluate_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NUDGE = 3e-8
_PIPE, _FUNCTIONS = TransformPipeline(), Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(F.col(f.name).cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def query(name: str, sql: str | None = None, reals: str = "", others: str = ""):
    """Registers ``name``; the SQL's result columns are ``others`` as they are and ``reals`` rounded."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            columns = ", ".join([*others.split(), *(f"round(CAST({c} AS DOUBLE) + {NUDGE!r}::DOUBLE, 6) + 0.0 AS {c}" for c in reals.split())])
            ORACLES[name] = f"SELECT {columns} FROM ({sql})"
        return fn

    return add


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.avg("value").alias("v"))


KEY_H, KEY_E = SeriesKey.of("t"), SeriesKey.of(("ts", "event_id"))
KEY_U = SeriesKey.of(("ts", "event_id"), "user_id")
H = "H AS (SELECT row_number() OVER (ORDER BY t) - 1 AS idx, t, v FROM (SELECT date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1))"
U = "U AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, user_id, event_id, ts, value AS v FROM events)"


def f(name: str, df: DataFrame, key: SeriesKey, field: str | None = None, **params) -> DataFrame:
    got = _FUNCTIONS.run(name, df, key, params)
    return got.scalars if field is None else got.series[field][0]


def t(df: DataFrame, key: SeriesKey | None, *steps) -> DataFrame:
    return _PIPE.run(df, steps, key)


# -- filter, sort, clip, units ------------------------------------------------------------------------------------------

_E = "event_id ts user_id event_type"
_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]
for _name, _params, _where in [
    ("filter_eq", {"column": "event_type", "operator": "==", "value": "error"}, "event_type = 'error'"),
    ("filter_ne", {"column": "event_type", "operator": "!=", "value": "click"}, "event_type <> 'click'"),
    ("filter_gt", {"column": "value", "operator": ">", "value": 100}, "value > 100"),
    ("filter_lt", {"column": "value", "operator": "<", "value": 10}, "value < 10"),
    ("filter_ge", {"column": "user_id", "operator": ">=", "value": 75}, "user_id >= 75"),
    ("filter_le", {"column": "user_id", "operator": "<=", "value": 20}, "user_id <= 20"),
    ("filter_in", {"column": "event_type", "operator": "in", "value": ["view", "signup"]}, "event_type IN ('view', 'signup')"),
    ("filter_notin", {"column": "event_type", "operator": "notIn", "value": ["view", "signup"]}, "event_type NOT IN ('view', 'signup')"),
    ("filter_isnotnull", {"column": "value", "operator": "isNotNull"}, "value IS NOT NULL"),
]:
    query(_name, f"SELECT * FROM events WHERE {_where}", "value", _E)(lambda s, d, p=_params: t(table(s, d, "events"), None, ("filter", p)).select(*_COLUMNS))

_BY = ["l_extendedprice", "l_orderkey", "l_linenumber"]


@query("sort_multi", f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, row_number() OVER (ORDER BY {', '.join(c + ' DESC' for c in _BY)}) - 1 AS position FROM lineitem", "l_quantity l_extendedprice", "l_orderkey l_linenumber position")
def _sort(s, d):
    """The rows with their places in the operator's own order: partition by partition, row by row."""
    from .series import materialised

    ordered = t(table(s, d, "lineitem"), None, ("sort", {"columns": _BY, "ascending": False})).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    placed = materialised(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "sorted")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))  # a row per partition
    return placed.join(F.broadcast(counts), "_part").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("_id") - F.shiftleft(F.col("_part"), 33) + F.col("_before")).cast("long").alias("position"))


query("clip", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 40) AS l_quantity FROM lineitem", "l_quantity", "l_orderkey l_linenumber")(
    lambda s, d: t(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), None, ("clip", {"column": "l_quantity", "min": 10, "max": 40}))
)
query("unit_convert", "SELECT l_orderkey, l_linenumber, (l_quantity - 32.0) * (5.0::DOUBLE / 9.0::DOUBLE) AS l_quantity FROM lineitem", "l_quantity", "l_orderkey l_linenumber")(
    lambda s, d: t(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), None, ("unit_convert", {"column": "l_quantity", "from": "F", "to": "C"}))
)

# -- fillna, resample ---------------------------------------------------------------------------------------------------

HGAP = f"WITH {H}, G AS (SELECT idx, t, CASE WHEN idx % 7 IN (3, 4) OR idx < 2 THEN NULL ELSE v END AS v FROM H)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .series import with_index

    i = F.col(INDEX)
    rows = with_index(hourly(spark, sf_dir), KEY_H)
    return rows.select("t", F.when(~((i % 7).isin(3, 4) | (i < 2)), F.col("v")).alias("v"))


query("filter_isnull", f"{HGAP} SELECT t FROM G WHERE v IS NULL", "", "t")(lambda s, d: t(gaps(s, d), None, ("filter", {"column": "v", "operator": "isNull"})).select("t"))
_LAST = "last_value(v IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "first_value(v IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_RUN = "idx - last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
for _name, _params, _sql in [
    ("fillna_value", {"method": "value", "value": 0.0}, "coalesce(v, 0)"),
    ("fillna_forward", {"method": "forward"}, _LAST),
    ("fillna_backward", {"method": "backward"}, _NEXT),
    ("fillna_interpolate", {"method": "interpolate"}, f"coalesce(v, {_NEXT} - ({_NEXT} - {_LAST}) / pow(2.0, {_RUN}), {_LAST}, {_NEXT})"),
]:
    query(_name, f"{HGAP} SELECT t, {_sql} AS v FROM G", "v", "t")(lambda s, d, p=_params: t(gaps(s, d), KEY_H, ("fillna", {"column": "v", **p})))

for _agg, _sql in [("mean", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("first", "arg_min(value, (ts, event_id))"), ("last", "arg_max(value, (ts, event_id))"), ("count", "CAST(count(value) AS DOUBLE)")]:
    query(f"resample_{_agg}", f"SELECT date_trunc('hour', ts) AS ts, {_sql} AS value FROM events GROUP BY 1", "value", "ts")(
        lambda s, d, a=_agg: t(table(s, d, "events").select("ts", "event_id", "value"), KEY_E, ("resample", {"interval": "1h", "aggregation": a}))
    )

# -- as-of joins, merging -----------------------------------------------------------------------------------------------

_L = "SELECT event_id, ts, value FROM events WHERE event_type = 'error'"
_R = "SELECT event_id AS r_id, ts AS r_ts, value AS pressure FROM events WHERE event_type = 'purchase'"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", F.col("ts").alias("_timestamp"), "value")
    return left, e.where("event_type = 'purchase'").select(F.col("event_id").alias("r_id"), F.col("ts").alias("_timestamp"), F.col("value").alias("pressure"))


_ASOF = f"WITH l AS ({_L}), r AS ({_R}), b AS (SELECT l.event_id, r.r_id, r.pressure, r.r_ts FROM l ASOF LEFT JOIN r ON l.ts >= r.r_ts), a AS (SELECT l.event_id, r.r_id, r.pressure, r.r_ts FROM l ASOF LEFT JOIN r ON l.ts <= r.r_ts)"
_NEAR = "SELECT l.event_id, l.value, CASE WHEN {first} THEN b.r_id ELSE a.r_id END AS r_id, CASE WHEN {first} THEN b.pressure ELSE a.pressure END AS pressure FROM l JOIN b USING (event_id) JOIN a USING (event_id)"
_D = "a.r_ts IS NULL OR (b.r_ts IS NOT NULL AND (epoch_us(l.ts) - epoch_us(b.r_ts)) // {unit} <= (epoch_us(a.r_ts) - epoch_us(l.ts)) // {unit})"
# of right rows at equal times the first by r_id counts, and each left row gives one row, as the operator has it
_FIRST = f"""WITH l AS ({_L}), r AS (SELECT r_ts, r_id, pressure FROM ({_R}) WHERE r_ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r_ts ORDER BY r_id) = 1),
b AS (SELECT l.event_id, l.value, l.ts, r.r_ts AS b_ts, r.r_id AS b_id, r.pressure AS b_pressure FROM l ASOF LEFT JOIN r ON l.ts >= r.r_ts),
a AS (SELECT b.*, r.r_ts AS a_ts, r.r_id AS a_id, r.pressure AS a_pressure FROM b ASOF LEFT JOIN r ON b.ts <= r.r_ts)"""
_DF = "a_ts IS NULL OR (b_ts IS NOT NULL AND (epoch_us(ts) - epoch_us(b_ts)) // 1000 <= (epoch_us(a_ts) - epoch_us(ts)) // 1000)"
for _m, _sql in [
    ("exact", f"WITH l AS ({_L}), r AS ({_R}) SELECT l.event_id, l.value, r.r_id, r.pressure FROM l LEFT JOIN r ON r.r_ts = l.ts"),
    ("backward", f"{_ASOF} SELECT l.event_id, l.value, b.r_id, b.pressure FROM l JOIN b USING (event_id)"),
    ("forward", f"{_ASOF} SELECT l.event_id, l.value, a.r_id, a.pressure FROM l JOIN a USING (event_id)"),
    ("nearest", _FIRST + " SELECT event_id, value, CASE WHEN {first} THEN b_id ELSE a_id END AS r_id, CASE WHEN {first} THEN b_pressure ELSE a_pressure END AS pressure FROM a".format(first=_DF)),
]:
    query(f"asof_{_m}", _sql, "value pressure", "event_id r_id")(lambda s, d, m=_m: asof_join(*sides(s, d), "_timestamp", m, right_order="r_id").drop("_timestamp"))


@query("merge_join", f"{_ASOF} " + _NEAR.format(first=_D.format(unit=1)), "value pressure", "event_id r_id")
def _merge_join(s, d):
    left, right = sides(s, d)
    return merge.merge([("append", left), ("join", right)]).drop("_timestamp")


@query("merge_append", f"SELECT event_id, ts, value, NULL::DOUBLE AS pressure FROM ({_L}) UNION ALL SELECT NULL, r_ts, NULL, pressure FROM ({_R})", "value pressure", "event_id ts")
def _merge_append(s, d):
    left, right = sides(s, d)
    return merge.merge([("append", left), ("append", right.drop("r_id"))]).withColumnRenamed("_timestamp", "ts")


@query("column_alias", "SELECT event_id, value AS reading FROM events", "reading", "event_id")
def _alias(s, d):
    return merge.alias_columns(table(s, d, "events").select("event_id", "value"), {"value": "reading"})


# -- statistics ---------------------------------------------------------------------------------------------------------

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in NUM)


def _m(k: int, v: str = "v", m: str = "m") -> str:
    return f"avg(pow({v} - {m}, {k}))"


_RANK = "max(CASE WHEN rn = CAST(floor({p} * (n - 1) + 0.5) AS BIGINT) THEN v END) AS {name}"
query(
    "descriptive_stats",
    f"WITH x AS ({_LONG}), y AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY \"column\") AS n, avg(v) OVER (PARTITION BY \"column\") AS m FROM x) "
    f"SELECT \"column\", count(*) AS \"count\", min(v) AS \"min\", max(v) AS \"max\", avg(v) AS \"avg\", stddev_samp(v) AS std, {_m(3)} / pow({_m(2)}, 1.5) AS skewness, {_m(4)} / pow({_m(2)}, 2) AS kurtosis, "
    + ", ".join(_RANK.format(p=p / 100, name=f"p{p}") for p in (25, 50, 75)) + ' FROM y GROUP BY "column"',
    '"min" "max" "avg" std skewness kurtosis p25 p50 p75', '"column" "count"',
)(lambda s, d: f("descriptive_stats", table(s, d, "lineitem").select(*NUM), SeriesKey.of(()), columns=NUM))

_REG = "WITH s AS (SELECT avg(x) mx, avg(y) my, covar_pop(x, y) c, var_pop(x) vx, var_pop(y) vy FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem))"
query("correlation_regression", f"{_REG} SELECT c / sqrt(vx * vy) AS correlation, c / vx AS slope, my - c / vx * mx AS intercept, c * c / (vx * vy) AS r_squared FROM s", "correlation slope intercept r_squared")(
    lambda s, d: f("correlation_regression", table(s, d, "lineitem"), SeriesKey.of(()), xColumn="l_quantity", yColumn="l_extendedprice")
)
query(
    "covariance_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 3) AS covariance, covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) AS correlation, count(*) AS rowCount FROM lineitem" for a in NUM[:3] for b in NUM[:3]),
    "covariance correlation", "a b rowCount",
)(lambda s, d: f("covariance_matrix", table(s, d, "lineitem"), SeriesKey.of(()), columns=NUM[:3]).withColumn("covariance", F.round("covariance", 3)))
query(
    "histogram",
    "WITH e AS (SELECT min(l_extendedprice) lo, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS w FROM lineitem), b AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 11) AS INTEGER) AS bin, count(*) AS c FROM lineitem, e GROUP BY 1) "
    "SELECT CAST(i AS INTEGER) AS bin, lo + i * w AS lo, lo + (i + 1) * w AS hi, coalesce(c, 0) AS \"count\" FROM range(12) r(i) LEFT JOIN b ON b.bin = i, e",
    "lo hi", 'bin "count"',
)(lambda s, d: f("histogram", table(s, d, "lineitem"), SeriesKey.of(()), "counts", column="l_extendedprice", bins=12).drop(INDEX))


def _poly(s, d, degree):
    r = _FUNCTIONS.run("regression", table(s, d, "lineitem"), SeriesKey.of(()), {"columns": ["l_quantity", "l_extendedprice"], "degree": degree})
    return r.scalars.select(*(F.round(f"c{k}", 3).alias(f"c{k}") for k in range(degree + 1)), "rSquared")


query("regression_deg1", f"{_REG} SELECT round(my - c / vx * mx, 3) AS c0, round(c / vx, 3) AS c1, c * c / (vx * vy) AS rSquared FROM s", "c0 c1 rSquared")(lambda s, d: _poly(s, d, 1))
query(
    "regression_deg2",
    "WITH p AS (SELECT l_quantity - 25 AS u, l_extendedprice AS y FROM lineitem), s AS (SELECT avg(u) a1, avg(u*u) a2, avg(u*u*u) a3, avg(u*u*u*u) a4, avg(y) b0, avg(u*y) b1, avg(u*u*y) b2 FROM p), "
    "k AS (SELECT *, (a2 - a1*a1) AS p11, (a3 - a1*a2) AS p12, (a4 - a2*a2) AS p22, (b1 - a1*b0) AS q1, (b2 - a2*b0) AS q2 FROM s), "
    "c AS (SELECT *, (q2*p11 - q1*p12) / (p11*p22 - p12*p12) AS k2 FROM k), c1 AS (SELECT *, (q1 - p12*k2) / p11 AS k1 FROM c), c0 AS (SELECT *, b0 - k1*a1 - k2*a2 AS k0 FROM c1), "
    "r AS (SELECT 1 - sum(pow(y - k0 - k1*u - k2*u*u, 2)) / (var_pop(y) * count(*)) AS r2 FROM p, c0) SELECT round(k0 - 25*k1 + 625*k2, 3) AS c0, round(k1 - 50*k2, 3) AS c1, round(k2, 3) AS c2, r2 AS rSquared FROM c0, r",
    "c0 c1 c2 rSquared",
)(lambda s, d: _poly(s, d, 2))
_TWO = "WITH s AS (SELECT avg(l_discount) mx, avg(l_tax) my, var_samp(l_discount) / count(l_discount) p, var_samp(l_tax) / count(l_tax) q, count(*) n FROM lineitem)"
query("ttest", f"{_TWO} SELECT (mx - my) / sqrt(p + q) AS statistic, (p + q) * (p + q) / (p*p/(n-1) + q*q/(n-1)) AS degreesOfFreedom, abs((mx - my) / sqrt(p + q)) > 1.96 AS significant FROM s", "statistic degreesOfFreedom", "significant")(
    lambda s, d: f("hypothesis_test", table(s, d, "lineitem"), SeriesKey.of(()), columns=["l_discount", "l_tax"])
)
query(
    "ks_test",
    "WITH a AS (SELECT l_discount v, count(*) na FROM lineitem GROUP BY 1), b AS (SELECT l_tax v, count(*) nb FROM lineitem GROUP BY 1), x AS (SELECT coalesce(a.v, b.v) v, coalesce(na, 0) na, coalesce(nb, 0) nb FROM a FULL JOIN b ON a.v = b.v), "
    "c AS (SELECT *, sum(na) OVER (ORDER BY v) ca, sum(nb) OVER (ORDER BY v) cb, sum(na) OVER () n, sum(nb) OVER () m FROM x), k AS (SELECT max(greatest(abs(ca/n - (cb - nb)/m), abs(ca/n - cb/m))) AS statistic, 1.358 * sqrt((max(n) + max(m)) / (max(n) * max(m))) AS criticalValue FROM c) "
    "SELECT statistic, criticalValue, statistic > criticalValue AS significant FROM k",
    "statistic criticalValue", "significant",
)(lambda s, d: f("hypothesis_test", table(s, d, "lineitem"), SeriesKey.of(()), columns=["l_discount", "l_tax"], test="ks"))
query("pca", "WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) r FROM lineitem) SELECT CAST(k AS INTEGER) AS component, 1 + (CASE k WHEN 0 THEN r ELSE -r END) AS explainedVariance, (1 + (CASE k WHEN 0 THEN r ELSE -r END)) / 2 AS explainedVarianceRatio FROM c, range(2) q(k)", "explainedVariance explainedVarianceRatio", "component")(
    lambda s, d: f("pca", table(s, d, "lineitem"), SeriesKey.of(()), columns=["l_quantity", "l_extendedprice"])
)
_RULES = [{"column": "value", "operator": ">", "value": 200, "label": "high"}, {"column": "value", "operator": ">=", "value": 50, "label": "mid"}, {"column": "event_type", "operator": "==", "value": "error", "label": "err"}]
_CASE = "CASE WHEN value > 200 THEN 'high' WHEN value >= 50 THEN 'mid' WHEN event_type = 'error' THEN 'err' ELSE 'low' END"
query("classification", f"SELECT event_id, {_CASE} AS _label FROM events", "", "event_id _label")(lambda s, d: f("rule_based_classification", table(s, d, "events"), KEY_E, "labeledRows", rules=_RULES, defaultLabel="low").select("event_id", "_label"))
query("classification_distribution", f"SELECT {_CASE} AS _label, count(*) AS \"count\" FROM events GROUP BY 1", "", '_label "count"')(lambda s, d: f("rule_based_classification", table(s, d, "events"), KEY_E, rules=_RULES, defaultLabel="low"))


def elog(s, d):
    e = table(s, d, "events")
    return e.withColumn("event", F.when(F.col("event_type") == "view", "recovered").otherwise(F.col("event_type"))).withColumnRenamed("ts", "_timestamp")


KEY_L = SeriesKey.of(("_timestamp", "event_id"))
EL = "L AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'view' THEN 'recovered' ELSE event_type END AS event FROM events)"
query("event_frequency", f"WITH {EL} SELECT event, count(*) AS \"count\" FROM L GROUP BY 1", "", 'event "count"')(lambda s, d: f("event_analysis", elog(s, d), KEY_L, "frequency"))
query("event_mtbf", f"WITH {EL} SELECT (max(ms) - min(ms)) // (count(*) - 1) // 60000 AS mtbf FROM L WHERE event = 'error'", "", "mtbf")(lambda s, d: f("event_analysis", elog(s, d), KEY_L, metrics=["mtbf"]))
query("event_mttr", f"WITH {EL} SELECT CAST(floor(avg(r.ms - x.ms) / 60000) AS BIGINT) AS mttr FROM (SELECT * FROM L WHERE event = 'error') x ASOF JOIN (SELECT * FROM L WHERE event = 'recovered') r ON x.ms < r.ms", "", "mttr")(
    lambda s, d: f("event_analysis", elog(s, d), KEY_L, metrics=["mttr"])
)
query("event_transitions", f"WITH {EL}, p AS (SELECT lag(event) OVER (ORDER BY idx) AS prev, event FROM L) SELECT prev || '->' || event AS transition, count(*) AS \"count\" FROM p WHERE prev IS NOT NULL GROUP BY 1", "", 'transition "count"')(
    lambda s, d: f("event_analysis", elog(s, d), KEY_L, "transitions", metrics=["transitions"])
)
query(
    "vibration",
    "WITH m AS (SELECT user_id, value v, avg(value) OVER (PARTITION BY user_id) m FROM events), s AS (SELECT user_id, count(*) n, sqrt(avg(v*v)) rms, max(abs(v)) peak, max(v) - min(v) AS peakToPeak, avg(pow(v-m,4)) / pow(avg(pow(v-m,2)),2) AS kurtosis, avg(pow(v-m,3)) / pow(avg(pow(v-m,2)),1.5) AS skewness FROM m GROUP BY 1) "
    "SELECT user_id, rms, peak, peakToPeak, peak / rms AS crestFactor, kurtosis, skewness, CASE WHEN rms <= 1.12 THEN 'A' WHEN rms <= 2.8 THEN 'B' WHEN rms <= 7.1 THEN 'C' ELSE 'D' END AS isoZone FROM s WHERE n >= 4",
    "rms peak peakToPeak crestFactor kurtosis skewness", "user_id isoZone",
)(lambda s, d: f("vibration_indicators", table(s, d, "events"), KEY_U, column="value"))
query(
    "hrv",
    f"WITH {U}, g AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY idx) AS dv FROM U) SELECT user_id, count(*) AS \"count\", avg(v) AS meanRR, 60000 / avg(v) AS meanHeartRate, stddev_samp(v) AS sdnn, sqrt(avg(dv*dv)) AS rmssd, 100.0 * count(*) FILTER (abs(dv) > 50) / (count(*) - 1) AS pnn50 FROM g GROUP BY 1",
    "meanRR meanHeartRate sdnn rmssd pnn50", 'user_id "count"',
)(lambda s, d: f("hrv_metrics", table(s, d, "events"), KEY_U, column="value"))

# -- anomalies ----------------------------------------------------------------------------------------------------------

_EMA = f"WITH RECURSIVE {H}, E AS (SELECT idx, v, v AS ema FROM H WHERE idx = 0 UNION ALL SELECT H.idx, H.v, {{a}} * H.v + (1 - {{a}}) * E.ema FROM E JOIN H ON H.idx = E.idx + 1)"
for _m2, _params, _sql in [
    ("threshold", {"threshold": 90.0}, f"WITH {H} SELECT idx, v AS value, v - 90 AS score FROM H WHERE v > 90"),
    ("zscore", {}, f"WITH {H}, s AS (SELECT avg(v) m, stddev_samp(v) s FROM H) SELECT idx, v AS value, abs(v - m) / s AS score FROM H, s WHERE abs(v - m) / s > 2"),
    ("iqr", {}, f"WITH {H}, r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 rn, count(*) OVER () n FROM H), q AS (SELECT max(CASE WHEN rn = floor(n * 0.25) THEN v END) q1, max(CASE WHEN rn = floor(n * 0.75) THEN v END) q3 FROM r), b AS (SELECT q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi FROM q) SELECT idx, v AS value, CASE WHEN v < lo THEN lo - v ELSE v - hi END AS score FROM H, b WHERE v < lo OR v > hi"),
    ("mad", {"sensitivity": 2.0}, f"WITH {H}, m AS (SELECT median(v) med FROM H), d AS (SELECT idx, v, abs(v - med) dev FROM H, m), k AS (SELECT median(dev) mad FROM d) SELECT idx, v AS value, 0.6745 * dev / mad AS score FROM d, k WHERE 0.6745 * dev / mad > 2"),
    ("ewma", {}, _EMA.format(a=0.3) + ", d AS (SELECT idx, v, abs(v - ema) dev FROM E), s AS (SELECT stddev_pop(dev) s FROM d) SELECT idx, v AS value, dev / s AS score FROM d, s WHERE dev > 2 * s"),
]:
    query(f"anomaly_{_m2}", _sql, "value score", "idx")(lambda s, d, m=_m2, p=_params: f("anomaly_detect", hourly(s, d), KEY_H, "anomalies", method=m, column="v", **p))

# -- series -------------------------------------------------------------------------------------------------------------


def _over(n: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


for _name, _fn, _field, _params, _sql in [
    ("moving_avg", "time_series_analysis", "moving_averages", {"windowSize": 5}, f"CASE WHEN idx >= 4 THEN avg(v) {_over(4)} END"),
    ("smoothing_sma", "smoothing", "values", {"window": 5}, f"avg(v) {_over(4)}"),
    ("envelope_rms", "envelope", "values", {"window": 8}, f"sqrt(avg(v * v) {_over(7)})"),
    ("envelope_peak", "envelope", "values", {"mode": "peak", "window": 8}, f"max(abs(v)) {_over(7)}"),
    ("filter_moving_average", "digital_filter", "values", {"type": "moving_average", "taps": 4}, f"avg(v) {_over(3)}"),
    ("filter_median", "digital_filter", "values", {"type": "median", "taps": 5}, "median(v) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
]:
    query(_name, f"WITH {U} SELECT user_id, event_id, {_sql} AS value FROM U", "value", "user_id event_id")(
        lambda s, d, fn=_fn, fi=_field, p=_params: f(fn, table(s, d, "events"), KEY_U, fi, column="value", **p).select("user_id", "event_id", "value")
    )
query("trend", f"WITH {U}, s AS (SELECT user_id, avg(idx) mi, avg(v) mv, covar_pop(idx, v) c, var_pop(idx) vi FROM U GROUP BY 1) SELECT user_id, c / vi AS slope, mv - c / vi * mi AS intercept FROM s", "slope intercept", "user_id")(
    lambda s, d: f("time_series_analysis", table(s, d, "events"), KEY_U, method="trend", column="value")
)
query("smoothing_ema", _EMA.format(a="(1.0 / 3)") + " SELECT idx, ema AS value FROM E", "value", "idx")(lambda s, d: f("smoothing", hourly(s, d), KEY_H, "values", method="ema", column="v", window=5).select(INDEX, "value"))
_SG = [-3, 12, 17, 12, -3]
query(
    "smoothing_savgol",
    f"WITH {H} SELECT idx, (" + " + ".join(f"{w} * coalesce({'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER (ORDER BY idx), {'first' if k < 0 else 'last'}_value(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" if k else f"{w} * v" for k, w in zip(range(-2, 3), _SG)) + ") / 35 AS value FROM H",
    "value", "idx",
)(lambda s, d: f("smoothing", hourly(s, d), KEY_H, "values", method="savgol", column="v", window=5).select(INDEX, "value"))
query("differencing", f"WITH {U}, g AS (SELECT *, v - 2 * lag(v, 2) OVER w + lag(v, 4) OVER w AS value FROM U WINDOW w AS (PARTITION BY user_id ORDER BY idx)) SELECT user_id, event_id, value FROM g WHERE idx >= 4", "value", "user_id event_id")(
    lambda s, d: f("differencing", table(s, d, "events"), KEY_U, "values", column="value", order=2, lag=2).select("user_id", "event_id", "value")
)
query("resample_decimate", f"WITH {H}, g AS (SELECT idx, avg(v) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value FROM H) SELECT idx // 4 AS idx, value FROM g WHERE idx % 4 = 0", "value", "idx")(
    lambda s, d: f("resample", hourly(s, d), KEY_H, "values", column="v", factor=4)
)
query(
    "resample_linear",
    f"WITH {H}, n AS (SELECT count(*) AS n FROM H), q AS (SELECT i, i * 4.0 / 3 AS p, n FROM n, range(0, CAST(floor(n.n * 3.0 / 4) AS BIGINT)) r(i)) SELECT i AS idx, a.v * (1 - (p - floor(p))) + b.v * (p - floor(p)) AS value FROM q JOIN H a ON a.idx = CAST(floor(p + 1e-9) AS BIGINT) JOIN H b ON b.idx = least(CAST(floor(p + 1e-9) AS BIGINT) + 1, n - 1)",
    "value", "idx",
)(lambda s, d: f("resample", hourly(s, d), KEY_H, "values", column="v", mode="linear", sourceRate=4.0, targetRate=3.0))
query("interpolate_linear", f"WITH {H} SELECT a.idx, a.idx + 0.5 AS query, (a.v + b.v) / 2 AS value FROM H a JOIN H b ON b.idx = a.idx + 1", "query value", "idx")(lambda s, d: f("interpolate", hourly(s, d), KEY_H, "values", column="v"))
query(
    "seasonality",
    f"WITH {H}, a AS (SELECT *, count(*) OVER () n, avg(v) OVER (ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) x, avg(v) OVER (ORDER BY idx ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) y FROM H), b AS (SELECT idx, v, CASE WHEN idx >= 12 AND idx < n - 12 THEN (x + y) / 2 END AS trend FROM a), "
    "p AS (SELECT idx % 24 AS ph, coalesce(avg(v - trend), 0) m FROM b GROUP BY 1), s AS (SELECT ph, m - (SELECT sum(m) / 24 FROM p) AS seasonal FROM p) SELECT idx, trend, seasonal, v - trend - seasonal AS residual FROM b JOIN s ON s.ph = b.idx % 24",
    "trend seasonal residual", "idx",
)(lambda s, d: f("seasonality_analysis", hourly(s, d), KEY_H, "trend", column="v", period=24).drop("t"))
query("zero_crossing", f"WITH {H}, z AS (SELECT idx, v - avg(v) OVER () AS x FROM H), p AS (SELECT idx, x, lag(x) OVER (ORDER BY idx) AS p FROM z) SELECT idx - 1 AS idx, p < 0 AS rising FROM p WHERE (p < 0) <> (x < 0)", "", "idx rising")(
    lambda s, d: f("zero_crossing", centred(s, d), KEY_H, "indices", column="x")
)
query("peak_detect", f"WITH {H}, p AS (SELECT idx, v, lag(v) OVER (ORDER BY idx) l, lead(v) OVER (ORDER BY idx) r FROM H) SELECT idx, v AS value FROM p WHERE v > l AND v >= r AND v >= 60", "value", "idx")(
    lambda s, d: f("peak_detect", hourly(s, d), KEY_H, "values", column="v", minHeight=60)
)
_GATED = (
    f"WITH RECURSIVE {H}, p AS (SELECT idx, v, lag(v) OVER w AS l, lead(v) OVER w AS r FROM H WINDOW w AS (ORDER BY idx)), c AS (SELECT idx, v FROM p WHERE v > l AND v >= r), "
    "e AS (SELECT c.idx, c.v, max(H.idx) FILTER (H.idx < c.idx AND H.v > c.v) AS a, min(H.idx) FILTER (H.idx > c.idx AND H.v > c.v) AS b FROM c, H GROUP BY 1, 2), "
    "m AS (SELECT e.idx, e.v, min(H.v) FILTER (H.idx <= e.idx AND H.idx > coalesce(e.a, -1)) AS lo, min(H.v) FILTER (H.idx >= e.idx AND H.idx < coalesce(e.b, 1000000000)) AS hi FROM e, H GROUP BY 1, 2), "
    "g AS MATERIALIZED (SELECT idx, v, row_number() OVER (ORDER BY v DESC, idx) AS k FROM m WHERE v - greatest(lo, hi) >= 20), "
    "t AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken UNION ALL SELECT g.k, CASE WHEN len(list_filter(taken, lambda x: abs(x - g.idx) < 6)) = 0 THEN list_append(taken, g.idx) ELSE taken END FROM t JOIN g ON g.k = t.k + 1) "
    "SELECT g.idx, g.v AS value FROM g WHERE list_contains((SELECT taken FROM t ORDER BY k DESC LIMIT 1), g.idx)"
)
query("peak_detect_gated", _GATED, "value", "idx")(lambda s, d: f("peak_detect", hourly(s, d), KEY_H, "values", column="v", minProminence=20, minDistance=6))


def centred(s, d):
    h = hourly(s, d)
    return h.crossJoin(F.broadcast(h.agg(F.avg("v").alias("m")))).select("t", (F.col("v") - F.col("m")).alias("x"))  # one row


_C = f"{H}, Z AS (SELECT idx, v - avg(v) OVER () AS x, count(*) OVER () AS n FROM H)"
query("acf", f"WITH {_C}, k AS (SELECT l AS lag FROM range(0, 49) r(l)), s AS (SELECT lag, sum(a.x * b.x) AS s FROM k, Z a JOIN Z b ON b.idx = a.idx + lag GROUP BY 1) SELECT lag AS idx, s / (SELECT s FROM s WHERE lag = 0) AS value FROM s", "value", "idx")(
    lambda s, d: f("acf", hourly(s, d), KEY_H, "acf", column="v", maxLag=48)
)


def two_channels(s, d):
    e = table(s, d, "events").withColumn("t", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("t").agg(F.avg("value").alias("a"), F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("b")).na.fill(0.0)


H2 = "H2 AS (SELECT row_number() OVER (ORDER BY t) - 1 AS idx, a, coalesce(b, 0) AS b, count(*) OVER () AS n FROM (SELECT date_trunc('hour', ts) t, avg(value) a, avg(CASE WHEN user_id % 2 = 0 THEN value END) b FROM events GROUP BY 1))"
query(
    "cross_correlation",
    f"WITH {H2}, z AS (SELECT idx, a - avg(a) OVER () a, b - avg(b) OVER () b FROM H2), n AS (SELECT sqrt(sum(a*a) * sum(b*b)) q FROM z), k AS (SELECT l - 24 AS lag FROM range(0, 49) r(l)), s AS (SELECT lag, sum(x.a * y.b) s FROM k, z x JOIN z y ON y.idx = x.idx + lag GROUP BY 1) SELECT lag + 24 AS idx, lag, s / q AS value FROM s, n",
    "value", "idx lag",
)(lambda s, d: f("cross_correlation", two_channels(s, d), KEY_H, "correlations", columns=["a", "b"], maxLag=24))
_CUSUM = (
    f"WITH RECURSIVE {H}, z AS (SELECT greatest(8, least(50, count(*) // 4)) AS size FROM H), "
    "b AS MATERIALIZED (SELECT h.idx, avg(x.v) AS mean, sqrt(greatest(coalesce(var_samp(x.v), 0), 1e-12)) AS sd FROM H h JOIN H x ON x.idx >= h.idx AND x.idx < h.idx + (SELECT size FROM z) GROUP BY 1), "
    "s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS origin, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, false AS hit UNION ALL "
    "SELECT i + 1, CASE WHEN h THEN i ELSE origin END, CASE WHEN h THEN 0.0 ELSE hi END, CASE WHEN h THEN 0.0 ELSE lo END, h FROM (SELECT *, hi > 4 OR lo < -4 AS h FROM ("
    "SELECT s.i, s.origin, CASE WHEN s.i < s.origin + z.size THEN 0.0 ELSE greatest(0, s.hi + (H.v - b.mean) / b.sd - 0.5) END AS hi, CASE WHEN s.i < s.origin + z.size THEN 0.0 ELSE least(0, s.lo + (H.v - b.mean) / b.sd + 0.5) END AS lo "
    "FROM s JOIN H ON H.idx = s.i JOIN b ON b.idx = s.origin, z))) SELECT i - 1 AS idx FROM s WHERE hit"
)
query("cusum", _CUSUM, "", "idx")(lambda s, d: f("changepoint_cusum", hourly(s, d), KEY_H, "changepoints", column="v", threshold=4.0))
query(
    "holt_winters",
    f"WITH RECURSIVE {H}, E AS (SELECT 0::BIGINT AS i, (SELECT v FROM H WHERE idx = 0) AS l, (SELECT v FROM H WHERE idx = 1) - (SELECT v FROM H WHERE idx = 0) AS b UNION ALL SELECT i + 1, 0.3 * v + 0.7 * (l + b), 0.1 * (0.3 * v + 0.7 * (l + b) - l) + 0.9 * b FROM E JOIN H ON H.idx = E.i), z AS (SELECT l, b FROM E ORDER BY i DESC LIMIT 1) SELECT h - 1 AS idx, l + h * b AS value FROM z, range(1, 11) r(h)",
    "value", "idx",
)(lambda s, d: f("holt_winters", hourly(s, d), KEY_H, "forecast", column="v"))
query("kalman_level", f"WITH RECURSIVE {H}, E AS (SELECT 0::BIGINT AS i, (SELECT v FROM H WHERE idx = 0) AS l, 1.0::DOUBLE AS p UNION ALL SELECT i + 1, l + (p + 0.001) / (p + 1.001) * (v - l), (p + 0.001) * (1 - (p + 0.001) / (p + 1.001)) FROM E JOIN H ON H.idx = E.i) SELECT i - 1 AS idx, l AS value FROM E WHERE i > 0", "value", "idx")(
    lambda s, d: f("kalman_filter", hourly(s, d), KEY_H, "filtered", column="v", model="level")
)
query(
    "kalman_trend",
    f"WITH RECURSIVE {H}, E AS (SELECT 0::BIGINT AS i, (SELECT v FROM H WHERE idx = 0) AS l, (SELECT v FROM H WHERE idx = 1) - (SELECT v FROM H WHERE idx = 0) AS b, 1.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, 1.0::DOUBLE AS p2 UNION ALL "
    "SELECT i + 1, l + b + n0 / (n0 + 1) * (v - l - b), b + n1 / (n0 + 1) * (v - l - b), (1 - n0 / (n0 + 1)) * n0, (1 - n0 / (n0 + 1)) * n1, n2 - n1 / (n0 + 1) * n1 FROM (SELECT *, p0 + 2 * p1 + p2 + 0.001 AS n0, p1 + p2 AS n1, p2 + 0.001 AS n2 FROM E) e JOIN H ON H.idx = e.i) SELECT i - 1 AS idx, l AS value FROM E WHERE i > 0",
    "value", "idx",
)(lambda s, d: f("kalman_filter", hourly(s, d), KEY_H, "filtered", column="v"))
_B = {"lowpass": ("(1 - co) / 2", "1 - co", "(1 - co) / 2"), "highpass": ("(1 + co) / 2", "-(1 + co)", "(1 + co) / 2"), "bandpass": ("al", "0", "-al"), "notch": ("1", "-2 * co", "1")}


def _coefficients(name: str, kind: str, cutoff: float, q: str = "0.7071") -> str:
    """A row b0, b1, b2, a1, a2 of the audio cookbook's formulas; ``cutoff`` in cycles a sample."""
    b = ", ".join(f"CAST(({x}) / (1 + al) AS DOUBLE) AS b{k}" for k, x in enumerate(_B[kind]))
    return f"{name} AS (SELECT {b}, -2 * co / (1 + al) AS a1, (1 - al) / (1 + al) AS a2 FROM (SELECT sin(2 * pi() * {cutoff}::DOUBLE) / (2 * {q}) AS al, cos(2 * pi() * {cutoff}::DOUBLE) AS co))"


def _section(name: str, source: str, k: str) -> str:
    """``name``: (idx, v) of ``source`` through the section ``k``."""
    step = f"SELECT e.i + 1, h.v, e.x1, k.b0 * h.v + k.b1 * e.x1 + k.b2 * e.x2 - k.a1 * e.y1 - k.a2 * e.y2, e.y1 FROM {name}_e e JOIN {source} h ON h.idx = e.i, {k} k"
    return f"{name}_e AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 UNION ALL {step}), {name} AS MATERIALIZED (SELECT i - 1 AS idx, y1 AS v FROM {name}_e WHERE i > 0)"


def _biquad_sql(kind: str, cutoff: float) -> str:
    return f"WITH RECURSIVE {H}, {_coefficients('K', kind, cutoff)}, {_section('Y', 'H', 'K')} SELECT idx, v AS value FROM Y"


_Q4 = ["(1 / (2 * sin(pi() / 8)))", "(1 / (2 * sin(3 * pi() / 8)))"]
_TURN = "{0} AS MATERIALIZED (SELECT (SELECT max(idx) FROM {1}) - idx AS idx, v FROM {1})"
_ZERO_PHASE = (
    f"WITH RECURSIVE {H}, {_coefficients('K', 'lowpass', 0.05, _Q4[0])}, {_coefficients('L', 'lowpass', 0.05, _Q4[1])}, {_section('A', 'H', 'K')}, {_section('B', 'A', 'L')}, {_TURN.format('R', 'B')}, {_section('C', 'R', 'K')}, {_section('D', 'C', 'L')}, {_TURN.format('Z', 'D')} SELECT idx, v AS value FROM Z"
)
_LOCKIN = (
    f"WITH RECURSIVE {_C}, {_coefficients('K', 'lowpass', 0.1 / 24)}, XC AS MATERIALIZED (SELECT idx, x * cos(2 * pi() * idx / 24.0) AS v FROM Z), XS AS MATERIALIZED (SELECT idx, x * sin(2 * pi() * idx / 24.0) AS v FROM Z), {_section('A', 'XC', 'K')}, {_section('B', 'A', 'K')}, {_section('C', 'XS', 'K')}, {_section('D', 'C', 'K')}, "
    "m AS (SELECT avg(B.v) AS i, avg(D.v) AS q FROM B JOIN D USING (idx) WHERE idx >= (SELECT CAST(floor(max(n) * 0.5) AS BIGINT) FROM Z)) SELECT 2 * sqrt(i * i + q * q) AS amplitude, atan2(i, q) AS phase, i, q FROM m"
)
_SPLINE = (
    f"WITH RECURSIVE {H}, n AS (SELECT max(idx) AS last FROM H), r AS MATERIALIZED (SELECT idx, 6 * (lead(v) OVER w - 2 * v + lag(v) OVER w) AS r FROM H WINDOW w AS (ORDER BY idx)), "
    "F AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d UNION ALL SELECT i + 1, 1 / (4 - c), (r.r - d) / (4 - c) FROM F JOIN r ON r.idx = F.i + 1, n WHERE F.i + 1 < n.last), G AS MATERIALIZED (SELECT * FROM F), "
    "M AS (SELECT last AS i, 0.0::DOUBLE AS m FROM n UNION ALL SELECT M.i - 1, G.d - G.c * M.m FROM M JOIN G ON G.i = M.i - 1) "
    "SELECT a.idx, a.idx + 0.5 AS query, (p.m + q.m) * 0.125 / 6 + (a.v - p.m / 6) * 0.5 + (b.v - q.m / 6) * 0.5 AS value FROM H a JOIN H b ON b.idx = a.idx + 1 JOIN M p ON p.i = a.idx JOIN M q ON q.i = a.idx + 1"
)
query("interpolate_spline", _SPLINE, "query value", "idx")(lambda s, d: f("interpolate", hourly(s, d), KEY_H, "values", column="v", method="spline"))
for _kind, _cut in [("lowpass", 0.05), ("highpass", 0.1), ("bandpass", 0.1), ("notch", 0.125)]:
    query(f"biquad_{_kind}", _biquad_sql(_kind, _cut), "value", "idx")(lambda s, d, k=_kind, c=_cut: f("digital_filter", hourly(s, d), KEY_H, "values", column="v", type=k, sampleRate=1.0, cutoff=c))
query("biquad_zero_phase", _ZERO_PHASE, "value", "idx")(lambda s, d: f("digital_filter", hourly(s, d), KEY_H, "values", column="v", type="lowpass", sampleRate=1.0, cutoff=0.05, order=4, zeroPhase=True))
query("lockin", _LOCKIN, "amplitude phase i q")(lambda s, d: f("lockin", centred(s, d), KEY_H, column="x", sampleRate=24.0, referenceFrequency=1.0))

# -- spectra ------------------------------------------------------------------------------------------------------------

_W = "(0.5 - 0.5 * cos(2 * pi() * {i} / ({n} - 1)))"
_NFFT = "CAST(pow(2, ceil(log2(n))) AS BIGINT)"
query(
    "fft",
    f"WITH {H}, n AS (SELECT count(*) n FROM H), w AS (SELECT idx, v * {_W.format(i='idx', n='n')} AS x, {_W.format(i='idx', n='n')} AS w, n, {_NFFT} AS m FROM H, n), g AS (SELECT sum(w) g FROM w), "
    "b AS (SELECT k, sum(x * cos(2 * pi() * ((k * idx) % m) / m)) re, sum(x * sin(2 * pi() * ((k * idx) % m) / m)) im, max(m) m FROM w, (SELECT unnest(range(0, (SELECT max(m) // 2 FROM w))) AS k) GROUP BY 1) SELECT k AS idx, k * 24.0 / m AS frequency, sqrt(re*re + im*im) * (CASE k WHEN 0 THEN 1 ELSE 2 END) / g AS magnitude, atan2(-im, re) AS phase FROM b, g",
    "frequency magnitude phase", "idx",
)(lambda s, d: f("fft", hourly(s, d), KEY_H, "magnitudes", column="v", sampleRate=24.0).select(INDEX, "frequency", "magnitude", "phase"))
_SEG = (
    "n AS (SELECT count(*) n FROM {src}), s AS (SELECT unnest(range(0, (SELECT (n - 64) // 32 + 1 FROM n))) AS seg), x AS (SELECT seg, idx - seg * 32 AS i, {cols} FROM s JOIN {src} ON idx >= seg * 32 AND idx < seg * 32 + 64), "
    "k AS (SELECT unnest(range(0, 32)) AS k), c AS (SELECT k, i, cos(2 * pi() * ((k * i) % 64) / 64) * " + _W.format(i="i", n=64) + " AS c, sin(2 * pi() * ((k * i) % 64) / 64) * " + _W.format(i="i", n=64) + " AS s FROM k, (SELECT unnest(range(0, 64)) AS i))"
)
_WW = "(SELECT sum(pow(" + _W.format(i="i", n=64) + ", 2)) FROM range(0, 64) r(i))"
_PSD = f"WITH {H}, {_SEG.format(src='H', cols='v')}, f AS (SELECT seg, k, sum(v * c) re, sum(v * s) im FROM x JOIN c USING (i) GROUP BY 1, 2), p AS (SELECT k, avg(re*re + im*im) * (CASE k WHEN 0 THEN 1 ELSE 2 END) / ({{rate}} * {_WW}) AS psd, count(*) AS segments FROM f GROUP BY 1)"
query("psd_welch", _PSD.format(rate="24.0") + " SELECT k AS idx, k * 24.0 / 64 AS frequency, psd, segments FROM p", "frequency psd", "idx segments")(lambda s, d: f("psd_welch", hourly(s, d), KEY_H, "psd", column="v", sampleRate=24.0, segmentLength=64))
query(
    "spectrogram",
    f"WITH {H}, {_SEG.format(src='H', cols='v')}, f AS (SELECT seg, k, sum(v * c) re, sum(v * s) im FROM x JOIN c USING (i) GROUP BY 1, 2) SELECT seg AS segment, k AS idx, (seg * 32 + 32) / 24.0 AS time, k * 24.0 / 64 AS frequency, sqrt(re*re + im*im) * (CASE k WHEN 0 THEN 1 ELSE 2 END) / 31.5 AS magnitude FROM f",
    "time frequency magnitude", "segment idx",
)(lambda s, d: f("spectrogram", hourly(s, d), KEY_H, "magnitudes", column="v", sampleRate=24.0, segmentLength=64))
query(
    "cross_psd",
    f"WITH {H2}, {_SEG.format(src='H2', cols='a, b')}, f AS (SELECT seg, k, sum(a * c) ar, -sum(a * s) ai, sum(b * c) br, -sum(b * s) bi FROM x JOIN c USING (i) GROUP BY 1, 2), p AS (SELECT k, sum(ar*ar + ai*ai) aa, sum(br*br + bi*bi) bb, sum(ar*br + ai*bi) re, sum(ar*bi - ai*br) im FROM f GROUP BY 1) "
    "SELECT k AS idx, k * 24.0 / 64 AS frequency, (re*re + im*im) / (aa * bb) AS coherence, sqrt(re*re + im*im) / aa AS frfMagnitude, atan2(im, re) AS frfPhase FROM p",
    "frequency coherence frfMagnitude frfPhase", "idx",
)(lambda s, d: f("cross_psd", two_channels(s, d), KEY_H, "coherence", columns=["a", "b"], sampleRate=24.0, segmentLength=64).select(INDEX, "frequency", "coherence", "frfMagnitude", "frfPhase"))
query(
    "eeg_bands",
    _PSD.format(rate="128.0") + ", b AS (SELECT band, sum(psd * 2.0) FILTER (k * 2.0 >= lo AND k * 2.0 < hi) AS power FROM p, (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 45.0)) q(band, lo, hi) GROUP BY 1) SELECT band, coalesce(power, 0) AS power, coalesce(power, 0) / (SELECT sum(power) FROM b) AS relative FROM b",
    "power relative", "band",
)(lambda s, d: f("eeg_band_powers", hourly(s, d), KEY_H, "bandPowers", column="v", sampleRate=128.0, segmentLength=64))
_CEPSTRUM = (
    f"WITH {H}, n AS (SELECT {_NFFT} AS m FROM (SELECT count(*) AS n FROM H)), k AS (SELECT unnest(range(0, (SELECT m FROM n))) AS k), "
    "b AS (SELECT k, sum(v * cos(2 * pi() * ((k * idx) % m) / m)) AS re, sum(v * sin(2 * pi() * ((k * idx) % m) / m)) AS im FROM H, k, n GROUP BY 1), g AS MATERIALIZED (SELECT k, ln(greatest(sqrt(re * re + im * im), 1e-300)) AS x FROM b) "
    "SELECT k.k AS idx, k.k / 24.0 AS quefrency, sum(x * cos(2 * pi() * ((k.k * g.k) % m) / m)) / max(m) AS value FROM k, g, n WHERE k.k < m // 2 GROUP BY 1"
)
query("cepstrum", _CEPSTRUM, "quefrency value", "idx")(lambda s, d: f("cepstrum", hourly(s, d), KEY_H, "cepstrum", column="v", sampleRate=24.0))
_HARMONICS = (
    f"WITH {_C}, m AS (SELECT {_NFFT} AS m, n FROM (SELECT max(n) AS n FROM Z)), b AS MATERIALIZED (SELECT k, sum(x * cos(2 * pi() * ((k * idx) % m) / m)) AS re, -sum(x * sin(2 * pi() * ((k * idx) % m) / m)) AS im, max(m) AS m, max(m.n) AS n FROM Z, m, (SELECT unnest(range(0, (SELECT m // 2 FROM m))) AS k) GROUP BY 1), "
    "a AS MATERIALIZED (SELECT k, k * 24.0 / m AS frequency, sqrt(re * re + im * im) * (CASE k WHEN 0 THEN 1 ELSE 2 END) / n AS amplitude, atan2(im, re) AS phase FROM b), f AS (SELECT arg_max(k, (amplitude, -k)) AS k0 FROM a WHERE k > 0), "
    "o AS (SELECT o AS ord, o * k0 AS near FROM f, (SELECT unnest(range(1, 11)) AS o) WHERE o * k0 < (SELECT m // 2 FROM m)), "
    "t AS (SELECT o.*, a.*, CASE a.k - near WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS r FROM o JOIN a ON abs(a.k - near) <= 1 AND (a.k = near OR a.k > 0)) "
    "SELECT ord - 1 AS idx, ord AS \"order\", frequency, amplitude, phase FROM t QUALIFY row_number() OVER (PARTITION BY ord ORDER BY amplitude DESC, r) = 1"
)
query("harmonics", _HARMONICS, "frequency amplitude phase", 'idx "order"')(lambda s, d: f("harmonics", centred(s, d), KEY_H, "harmonics", column="x", sampleRate=24.0))


def uneven(s, d):
    return table(s, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600 - 473352).alias("x"), F.col("value").alias("y"))


query(
    "lomb_scargle",
    "WITH r AS (SELECT epoch_us(ts) / 1e6 / 3600 - 473352 AS t, value AS y0 FROM events), z AS (SELECT t, y0 - avg(y0) OVER () AS y, var_samp(y0) OVER () AS var FROM r), k AS (SELECT k, 0.01::DOUBLE + (0.2::DOUBLE - 0.01::DOUBLE) * k / 39 AS f FROM range(0, 40) q(k)), "
    "a AS (SELECT k, f, atan2(sum(sin(4 * pi() * f * t)), sum(cos(4 * pi() * f * t))) / (4 * pi() * f) AS tau FROM k, z GROUP BY k, f), b AS (SELECT k, f, sum(y * cos(2 * pi() * f * (t - tau))) yc, sum(pow(cos(2 * pi() * f * (t - tau)), 2)) cc, sum(y * sin(2 * pi() * f * (t - tau))) ys, sum(pow(sin(2 * pi() * f * (t - tau)), 2)) ss, max(var) var FROM a, z GROUP BY k, f) "
    "SELECT k AS idx, f AS frequency, (yc*yc/cc + ys*ys/ss) / (2 * var) AS power FROM b",
    "frequency power", "idx",
)(lambda s, d: f("lomb_scargle", uneven(s, d), SeriesKey.of("x"), "power", columns=["x", "y"], minFrequency=0.01, maxFrequency=0.2, frequencySteps=40))


# -- windows, alerts ----------------------------------------------------------------------------------------------------

query(
    "sliding_window_agg",
    "SELECT event_id, avg(value) OVER w AS avg, min(value) OVER w AS min, max(value) OVER w AS max, sum(value) OVER w AS sum, CAST(count(value) OVER w AS DOUBLE) AS count, coalesce(stddev_samp(value) OVER w, 0) AS std FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 2 HOURS PRECEDING AND CURRENT ROW)",
    '"avg" "min" "max" "sum" "count" std', "event_id",
)(lambda s, d: windows.sliding(table(s, d, "events").select("event_id", "ts", "value"), "ts", "value", "2h", list(windows.AGGREGATES)).drop("ts", "value"))
query(
    "tumbling_window_agg",
    "SELECT user_id, date_trunc('day', ts) AS start, avg(value) AS avg, min(value) AS min, max(value) AS max, sum(value) AS sum, CAST(count(value) AS DOUBLE) AS count, coalesce(stddev_samp(value), 0) AS std FROM events GROUP BY 1, 2",
    '"avg" "min" "max" "sum" "count" std', "user_id start",
)(lambda s, d: windows.tumbling(table(s, d, "events"), "ts", "value", "1d", list(windows.AGGREGATES), ["user_id"]))
NOW = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
_RULES_SQL = {
    "alert_simple": ("value > 450", "SELECT bool_or(value > 450) AS triggered, coalesce(arg_min(value, (ts, event_id)) FILTER (value > 450), arg_max(value, (ts, event_id))) AS value FROM events"),
    "alert_window": ("avg(value, 6h) > 40", "SELECT avg(value) > 40 AS triggered, avg(value) AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOURS"),
    "alert_rate": ('rate(event_type, "error", 12h) >= 0.05', "SELECT count(*) / 720.0 >= 0.05 AS triggered, count(*) / 720.0 AS value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-30 00:00:00'"),
}
for _name, (_cond, _sql) in _RULES_SQL.items():
    query(_name, _sql, "value", "triggered")(lambda s, d, c=_cond: evaluate_frame(table(s, d, "events").withColumnRenamed("ts", "_timestamp"), [Rule("r", c)], ["_timestamp", "event_id"], NOW).select("triggered", "value"))

# -- generated signals, composition -------------------------------------------------------------------------------------

_TONE = {"samples": 2048, "sampleRate": 256.0, "components": [{"kind": "constant", "level": 1.5}, {"kind": "trend", "slope": 0.25}, {"kind": "sine", "amplitude": 2.0, "frequency": 16.0, "phase": 0.5}, {"kind": "step", "at": 1000, "level": 3.0}, {"kind": "impulse", "at": 77, "level": 9.0}]}
query(
    "synthetic_tone",
    "SELECT TIMESTAMP '2026-01-01 00:00:00' + to_microseconds(CAST(i * 3906 AS BIGINT)) AS _timestamp, 1.5 + 0.25 * (i / 256.0) + 2 * sin(2 * pi() * 16 * (i / 256.0) + 0.5) + (CASE WHEN i >= 1000 THEN 3 ELSE 0 END) + (CASE WHEN i = 77 THEN 9 ELSE 0 END) AS value FROM range(0, 2048) r(i)",
    "value", "_timestamp",
)(lambda s, d: synthetic.generate(s, _TONE).select(F.col("_timestamp").cast("timestamp_ntz").alias("_timestamp"), "value"))
_RLC = {"samples": 600, "sampleRate": 1000.0, "components": [{"kind": "rlc", "r": 0.1, "l": 0.01, "c": 0.01}]}
_RK = (
    "WITH RECURSIVE c AS (SELECT 0.1::DOUBLE / 0.01 AS a, 1 / 0.01::DOUBLE AS b, 1 / 0.01::DOUBLE AS g, 0.001::DOUBLE AS h), E AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT i + 1, x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), y + h / 6 * (l1 + 2 * l2 + 2 * l3 + l4) FROM ("
    "SELECT *, -a * (x + h * k3) - b * (y + h * l3) + b AS k4, g * (x + h * k3) AS l4 FROM (SELECT *, -a * (x + h / 2 * k2) - b * (y + h / 2 * l2) + b AS k3, g * (x + h / 2 * k2) AS l3 FROM (SELECT *, -a * (x + h / 2 * k1) - b * (y + h / 2 * l1) + b AS k2, g * (x + h / 2 * k1) AS l2 FROM (SELECT *, -a * x - b * y + b AS k1, g * x AS l1 FROM E, c WHERE i < 599))))) "
    "SELECT i, y AS value FROM E"
)
query("synthetic_rlc", _RK, "value", "i")(lambda s, d: synthetic.generate(s, _RLC).select(((F.unix_micros("_timestamp") - 1767225600000000) / 1000).cast("long").alias("i"), "value"))
_TF = {"samples": 500, "sampleRate": 100.0, "components": [{"kind": "transfer_function", "num": [1], "den": [1, 1]}]}
query("synthetic_transfer_function", "SELECT i, 1 - pow(1 - 0.01 + 0.0001 / 2 - 0.000001 / 6 + 0.00000001 / 24, i) AS value FROM range(0, 500) r(i)", "value", "i")(
    lambda s, d: synthetic.generate(s, _TF).select(((F.unix_micros("_timestamp") - 1767225600000000) / 10000).cast("long").alias("i"), "value")
)
query("synthetic_ensemble")(lambda s, d: synthetic.generate(s, {"samples": 200, "sampleRate": 10.0, "seed": 3, "components": [{"kind": "noise", "std": 2.0}], "ensemble": {"runs": 50, "percentiles": [5, 50, 95]}}))


@query("step_graph_fft_peaks", f"WITH f AS ({{fft}}), p AS (SELECT idx, magnitude, lag(magnitude) OVER (ORDER BY idx) l, lead(magnitude) OVER (ORDER BY idx) r FROM f) SELECT idx, magnitude AS value FROM p WHERE magnitude > l AND magnitude >= r AND magnitude >= 2".replace("{fft}", ORACLES["fft"]), "value", "idx")
def _step_graph(s, d):
    """A spectrum's magnitudes as the input of peak detection."""
    spectrum = f("fft", hourly(s, d), KEY_H, "magnitudes", column="v", sampleRate=24.0).select(F.col(INDEX).alias("bin"), F.round(F.col("magnitude") + NUDGE, 6).alias("magnitude"))
    return f("peak_detect", spectrum, SeriesKey.of("bin"), "values", column="magnitude", minHeight=2)


@query("spec_batch", "SELECT name, value FROM (SELECT 'peak' AS name, max(v) AS value FROM (SELECT date_trunc('hour', ts) t, avg(value) v FROM events WHERE event_type = 'error' GROUP BY 1)) ", "value", "name")
def _spec_batch(s, d):
    """A whole spec through the engine: source, transforms, step, metric."""
    from .plans.engine import Engine
    from .sources.registry import SourceRegistry, TableSource

    sources = SourceRegistry({"table": TableSource(f"{d}/{{query}}.parquet")})
    engine = Engine(s, sources)
    spec = engine.create_spec({
        "specId": "errors", "version": "1.0.0", "inputSources": [{"sourceType": "table", "query": "events", "filter": "event_type = 'error'", "columnAliases": {"ts": "_timestamp"}}],
        "transforms": [{"name": "resample", "parameters": {"interval": "1h", "aggregation": "mean"}}],
        "analysisSteps": [{"id": "stats", "function": "descriptive_stats", "parameters": {"columns": ["value"]}}], "outputs": [{"name": "peak", "type": "metric", "from": "stats", "field": "max"}],
    })
    job = engine.run(spec)
    rows = [(a.name, float(a.value)) for a in engine.artifacts.query(job.job_id)]
    return s.createDataFrame(rows, "name string, value double")


_FLAG = "SELECT count(*) AS \"count\", min(v) AS \"min\", max(v) AS \"max\", avg(v) AS \"avg\" FROM (SELECT avg(value) AS v FROM events WHERE event_type = 'error' GROUP BY date_trunc('hour', ts))"


@query("flagship", _FLAG, '"min" "max" "avg"', '"count"')
def flagship(s, d):
    steps = [("filter", {"column": "event_type", "operator": "==", "value": "error"}), ("resample", {"interval": "1h", "aggregation": "mean"})]
    rows = t(table(s, d, "events").select("ts", "event_type", "value"), None, *steps)
    return f("descriptive_stats", rows, SeriesKey.of("ts"), columns=["value"]).select("count", "min", "max", "avg")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
