"""The seven transforms: DataFrame in, DataFrame out, all lazy."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durations import seconds
from ..errors import EngineError
from ..series import INDEX, SeriesKey, carried, with_index
from .steplog import StepLog
from .asof import asof_join

OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "in", "notIn", "isNull", "isNotNull")
AGGREGATIONS = ("mean", "sum", "min", "max", "first", "last", "count")

#: Fixed values: (from, to) -> subtract, multiply, add, in that order.
UNITS: dict[tuple[str, str], tuple[float, float, float]] = {
    ("C", "F"): (0, 9.0 / 5.0, 32.0),
    ("F", "C"): (32.0, 5.0 / 9.0, 0),
    ("C", "K"): (0, 1, 273.15),
    ("K", "C"): (273.15, 1, 0),
    ("m/s", "km/h"): (0, 3.6, 0),
    ("km/h", "m/s"): (0, 1.0 / 3.6, 0),
    ("km/h", "mph"): (0, 0.621371, 0),
    ("mph", "km/h"): (0, 1.60934, 0),
    ("Pa", "kPa"): (0, 0.001, 0),
    ("kPa", "Pa"): (0, 1000.0, 0),
    ("bar", "Pa"): (0, 100000.0, 0),
    ("Pa", "bar"): (0, 0.00001, 0),
    ("m", "km"): (0, 0.001, 0),
    ("km", "m"): (0, 1000.0, 0),
    ("ft", "m"): (0, 0.3048, 0),
    ("m", "ft"): (0, 3.28084, 0),
}


def _need(params: Mapping[str, Any], name: str, transform: str) -> Any:
    if params.get(name) is None:
        raise EngineError("transform.parameter_error", f'{transform} needs "{name}"', step=transform)
    return params[name]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _same_kind(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_numeric(kind)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def predicate(df: DataFrame, column: str, operator: str, value: Any = None) -> Column:
    """A null cell fails every operator but isNull. == compares without conversion: a number never equals a string.

    Ordered operators read both sides as numbers, 0 for what isn't one; times are compared as times.
    """
    if column not in df.columns:
        return F.lit(operator == "isNull")
    c, kind = F.col(column), df.schema[column].dataType
    if operator == "isNull":
        return c.isNull()
    if operator == "isNotNull":
        return c.isNotNull()
    if operator in ("in", "notIn"):
        known = [v for v in (value or []) if _same_kind(kind, v)] if isinstance(value, (list, tuple, set)) else []
        inside = c.isin(known) if known else F.lit(False)
        return c.isNotNull() & (inside if operator == "in" else ~inside)
    if operator in ("==", "!="):
        equal = (c == F.lit(value)) if value is not None and _same_kind(kind, value) else F.lit(False)
        return c.isNotNull() & (equal if operator == "==" else ~equal)
    if operator not in (">", "<", ">=", "<="):
        return F.lit(False)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        a, b = c, F.lit(value).cast(kind)
    else:
        try:
            number = float(value)
        except (TypeError, ValueError):
            number = 0.0
        a = c.cast("double") if is_numeric(kind) else F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))
        b = F.lit(number)
    return c.isNotNull() & {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[operator]


def filter_rows(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    return df.where(predicate(df, _need(params, "column", "filter"), params.get("operator", "=="), params.get("value")))


def sort_rows(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    """Nulls first ascending, last descending; one direction for all columns."""
    columns = _need(params, "columns", "sort")
    columns = [columns] if isinstance(columns, str) else list(columns)
    up = params.get("ascending", True)
    return df.orderBy(*(F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c in columns))


def fillna(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    """value, forward, backward, or interpolate: each null is the mean of the value before, filled, and the next known one.

    For the j-th null of a run between a and b that is b - (b - a) / 2**j; where one side is missing, the other.
    """
    method = params.get("method", "value")
    columns = [params["column"]] if params.get("column") else [c for c in df.columns if c not in ((*key.partition_by, *key.order_by) if key else ())]
    if method == "value":
        value = params.get("value")
        fits = [c for c in columns if value is not None and _same_kind(df.schema[c].dataType, value)]
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in fits})
    if key is None:
        raise EngineError("transform.parameter_error", f"fillna {method} needs an order", step="fillna")
    if method == "interpolate":
        columns = [c for c in columns if is_numeric(df.schema[c].dataType)]
    work, names = with_index(df, key), df.columns
    if method in ("forward", "interpolate"):
        work = carried(work, key, {f"_f{i}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(INDEX).alias("i"))) for i, c in enumerate(columns)})
    if method in ("backward", "interpolate"):
        work = carried(work, key, {f"_n{i}": F.col(c) for i, c in enumerate(columns)}, backward=True)
    new = {}
    for i, c in enumerate(columns):
        if method == "forward":
            new[c] = F.coalesce(F.col(c), F.col(f"_f{i}.v"))
        elif method == "backward":
            new[c] = F.coalesce(F.col(c), F.col(f"_n{i}"))
        elif method == "interpolate":
            a, b = F.col(f"_f{i}.v").cast("double"), F.col(f"_n{i}").cast("double")
            new[c] = F.coalesce(F.col(c).cast("double"), b - (b - a) / F.pow(F.lit(2.0), F.col(INDEX) - F.col(f"_f{i}.i")), a, b)
    return work.withColumns(new).select(*names)


def clip(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    """Numbers into [min, max], max last; null and NaN stay."""
    column = _need(params, "column", "clip")
    if column not in df.columns or not is_numeric(df.schema[column].dataType):
        raise EngineError("transform.schema_error", f'clip needs a numeric column, not "{column}"', step="clip")
    c = out = F.col(column).cast("double")
    if params.get("min") is not None:
        out = F.when(out < float(params["min"]), float(params["min"])).otherwise(out)
    if params.get("max") is not None:
        out = F.when((out > float(params["max"])) & ~F.isnan(c), float(params["max"])).otherwise(out)
    return df.withColumn(column, out)


def unit_convert(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    """Values by the fixed pairs; an unknown pair leaves them. The new unit is stamped on the column either way."""
    column, a, b = (_need(params, k, "unit_convert") for k in ("column", "from", "to"))
    c = F.col(column).cast("double")
    if (a, b) in UNITS:
        minus, times, plus = UNITS[a, b]
        c = (c - F.lit(float(minus))) * F.lit(float(times)) + F.lit(float(plus))
    return df.withColumn(column, c.alias(column, metadata={"unit": b}))


def time_column(df: DataFrame) -> str | None:
    """The first column of a time type, or one whose name has "timestamp"."""
    timed = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) or "timestamp" in f.name.lower()]
    return timed[0] if timed else None


def resample(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    """Time buckets from the epoch; the time becomes the bucket's start, numbers are aggregated, other columns go.

    Empty buckets don't appear.  ``count`` is null where a bucket has no number.  first and last go by time, then by
    the key's order.  A bad interval counts as 5m, an unknown aggregation as mean; without a time column nothing changes.
    """
    ts = time_column(df)
    if ts is None:
        return df
    size = seconds(str(params.get("interval", "5m"))) * 1_000_000
    how = params.get("aggregation", "mean")
    parts = list(key.partition_by) if key else []
    t = F.col(ts).try_cast("timestamp") if isinstance(df.schema[ts].dataType, T.StringType) else F.col(ts).cast("timestamp")
    micros = F.unix_micros(t)
    # buckets fold around the epoch: both neighbours of zero have number 0
    bucket = F.when(micros >= 0, F.floor(micros / size)).otherwise(F.ceil(micros / size)).cast("long")
    order = F.struct(micros.alias("t"), *([F.col(c) for c in key.order_by] if key else []))
    numbers = [f.name for f in df.schema if is_numeric(f.dataType) and f.name != ts and f.name not in parts and f.name not in (key.order_by if key else ())]

    def agg(c: str) -> Column:
        v, at = F.col(c).cast("double"), F.when(F.col(c).isNotNull(), order)
        n = F.count(c)
        made = {"sum": F.sum(v), "min": F.min(v), "max": F.max(v), "first": F.min_by(v, at), "last": F.max_by(v, at), "count": F.when(n > 0, n).cast("double")}
        return made.get(how, F.avg(v)).alias(c)

    rows = df.where(t.isNotNull()).groupBy(*parts, bucket.alias("_bucket")).agg(*(agg(c) for c in numbers)) if numbers else df.where(t.isNotNull()).select(*parts, bucket.alias("_bucket")).distinct()
    start = F.timestamp_micros(F.col("_bucket") * size)
    return rows.select(*parts, start.cast(df.schema[ts].dataType if not isinstance(df.schema[ts].dataType, T.StringType) else "timestamp").alias(ts), *numbers)


def join(df: DataFrame, params: Mapping[str, Any], key: SeriesKey | None = None) -> DataFrame:
    right = params.get("rightData")
    if right is None or (isinstance(right, (list, tuple)) and not right):
        return df
    if not isinstance(right, DataFrame):
        right = df.sparkSession.createDataFrame(list(right))
    return asof_join(df, right, params.get("timestampColumn", "_timestamp"), params.get("method", "nearest"), by=key.partition_by if key else ())


Transform = Callable[[DataFrame, Mapping[str, Any], "SeriesKey | None"], DataFrame]
BUILT_IN: dict[str, Transform] = {"filter": filter_rows, "sort": sort_rows, "fillna": fillna, "clip": clip, "resample": resample, "join": join, "unit_convert": unit_convert}


class TransformPipeline:
    """Applies steps by name, in order; ``custom`` handlers go before the built-in ones."""

    def __init__(self, custom: Mapping[str, Transform] | None = None):
        self.handlers = BUILT_IN | dict(custom or {})

    def run(self, df: DataFrame, steps: Sequence[tuple[str, Mapping[str, Any]]], key: SeriesKey | None = None, log: StepLog | None = None) -> DataFrame:
        """The steps in order; with ``log`` each one's rows are observed."""
        for name, params in steps:
            handler = self.handlers.get(name)
            if handler is None:
                raise EngineError("transform.unknown", f'no transform "{name}"', step=name)
            try:
                df = handler(df, params, key)
            except EngineError:
                raise
            except Exception as e:
                raise EngineError("transform.failed", f"{name}: {e}", step=name) from e
            df = log.watch(df, f"transform:{name}") if log is not None else df
        return df

    def output_schema(self, spark, schema: T.StructType, steps, key: SeriesKey | None = None) -> T.StructType:
        """What the steps make of ``schema``, found by the analyser on an empty table."""
        return self.run(spark.createDataFrame([], schema), steps, key).schema


