"""Merging sources: aliases, append, and alignment by nearest time or by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..series import INDEX, SeriesKey, with_index
from .asof import asof_join

TIME = "_timestamp"


def alias_columns(df: DataFrame, aliases: Mapping[str, str] | None) -> DataFrame:
    """Columns renamed; a renamed column keeps no unit."""
    for old, new in (aliases or {}).items():
        if old in df.columns:
            df = df.withColumn(old, F.col(old).alias(old, metadata={})).withColumnRenamed(old, new)
    return df


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, nulls for what a side lacks."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def align(left: DataFrame, right: DataFrame, order: str | None = None) -> DataFrame:
    """``left`` with the right columns: by nearest time if both have times, else by position (then ``order`` is needed)."""
    shared = [c for c in right.columns if c in left.columns and c != TIME]
    if shared:
        raise EngineError("source.column_collision", f"both sides have {', '.join(shared)}", details={"columns": shared})
    if TIME in left.columns and TIME in right.columns:
        return asof_join(left, right, TIME, "nearest", unit="us")
    first = lambda df: SeriesKey.of(order or df.columns[0])
    a, b = with_index(left, first(left)), with_index(right.drop(TIME), first(right))
    return a.join(b, INDEX, "left").drop(INDEX)


def merge(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``parts``: (append | join, frame) in order; the first one's mode doesn't matter."""
    out = parts[0][1]
    for mode, frame in parts[1:]:
        out = align(out, frame) if mode == "join" else append([out, frame])
    return out
