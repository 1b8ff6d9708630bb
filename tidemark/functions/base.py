"""What analysis functions share: parameters, columns, results, kernels per series."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import INDEX, SeriesKey, with_index

Params = Mapping[str, Any]


@dataclass
class Result:
    """``scalars``: one row per series. ``series``: result field -> (frame with idx, its column). ``plain``: small driver values."""

    scalars: DataFrame | None = None
    series: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    plain: dict[str, Any] = field(default_factory=dict)


def numeric_columns(df: DataFrame, key: SeriesKey | None = None) -> list[str]:
    taken = {*key.order_by, *key.partition_by, INDEX} if key else {INDEX}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in taken]


def column_of(df: DataFrame, params: Params, key: SeriesKey | None = None) -> str:
    """The named column, else the first numeric one."""
    if params.get("column"):
        return params["column"]
    found = numeric_columns(df, key)
    if not found:
        raise ValueError("there is no numeric column")
    return found[0]


def number(params: Params, name: str, default: float | None = None) -> float | None:
    v = params.get(name)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def rate_of(params: Params, what: str) -> float:
    rate = number(params, "sampleRate")
    if rate is None or rate <= 0:
        raise ValueError(f"{what} needs a positive sampleRate in Hz")
    return rate


def one_series(key: SeriesKey | None, what: str) -> None:
    """Refuses partition keys where a function has one result for the whole table, rather than mixing the series."""
    if key and key.partition_by:
        raise ValueError(f"{what} takes one series; filter by {', '.join(key.partition_by)} first")


def sample(df: DataFrame, key: SeriesKey, *columns: str) -> DataFrame:
    """The series' columns as doubles, rows with a null in any of them left out, with ``idx`` among those that stay."""
    keep = list(dict.fromkeys([*key.partition_by, *key.order_by]))
    rows = df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns if c not in keep))
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return with_index(rows, key)


def per_series(rows: DataFrame, key: SeriesKey, columns: list[str], fn: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each series' arrays in order. One series must fit a task: for kernels that need all of it at once."""
    parts = list(key.partition_by)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in parts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        out = fn(*(pdf[c].to_numpy(np.float64) for c in columns))
        for i, c in enumerate(parts):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return rows.select(*parts, INDEX, *columns).groupBy(*(parts or [F.lit(0).alias("_one")])).applyInPandas(run, kinds + schema)


def long_frame(**columns: Any) -> pd.DataFrame:
    n = max(len(v) for v in columns.values() if hasattr(v, "__len__")) if columns else 0
    return pd.DataFrame({INDEX: np.arange(n, dtype=np.int64), **columns})
