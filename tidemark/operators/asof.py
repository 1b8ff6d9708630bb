"""As-of joins as union and carry: one sort, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import INDEX, SeriesKey, carried, with_index

METHODS = ("nearest", "exact", "forward", "backward")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, on: str = "_timestamp", method: str = "nearest", by: Sequence[str] = (), right_order: str | None = None, unit: str = "ms") -> DataFrame:
    """``left`` with the columns of the right row that ``method`` picks by time; left rows all stay.

    exact: the first row of equal time.  backward: the last row at or before.  forward: the first at or after.
    nearest: least distance in ``unit`` (ms or us), the earlier row on a tie, the first of equal times; unknown
    methods count as nearest.  Rows of the right side without time are left out; left rows without time get nulls.
    Columns that both sides have keep the left value.  ``right_order`` tells rows of equal time apart.
    """
    by = list(by)
    extra = [c for c in right.columns if c not in left.columns and c != on]
    if not extra:
        return left
    seq = F.col(right_order) if right_order else F.xxhash64(*right.columns)
    payload = F.struct(F.col(on).alias("_rt"), *extra)
    first = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.min_by(payload, seq).alias("_first"), F.max_by(payload, seq).alias("_last"))
    if method == "exact":
        out = left.join(first.withColumnRenamed(on, "_on"), [left[on] == F.col("_on"), *(left[c] == first[c] for c in by)] if by else left[on] == F.col("_on"), "left")
        return out.select(*(left[c] for c in left.columns), *(F.col(f"_first.{c}").alias(c) for c in extra))
    lrow = left.select(F.struct(*left.columns).alias("_row"), *by, F.col(on).alias("_t"))
    rrow = first.select(*by, F.col(on).alias("_t"), "_first", "_last")
    both = lrow.withColumn("_right", F.lit(False)).unionByName(rrow.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    dated = both.where(F.col("_t").isNotNull())
    key = SeriesKey.of(["_t", "_side"], by)
    # at equal times the right row comes first for looking back, and last for looking ahead: one index serves each
    back = method != "forward"
    ahead = method not in ("backward",)
    use_last = method == "backward"
    work = with_index(dated.withColumn("_side", F.when(F.col("_right"), 0).otherwise(1)), key)
    if back:
        work = carried(work, key, {"_b": F.when(F.col("_right"), F.col("_last" if use_last else "_first"))})
    if ahead:
        # a right row at the same time precedes its left rows in this order, so it is taken from the carry back
        work = carried(work, key, {"_b0": F.when(F.col("_right"), F.col("_first"))}) if not back else work.withColumn("_b0", F.col("_b"))
        work = carried(work, key, {"_a": F.when(F.col("_right"), F.col("_first"))}, backward=True)
        same = F.col("_b0._rt") == F.col("_t")
        work = work.withColumn("_a", F.when(same, F.col("_b0")).otherwise(F.col("_a")))
    t = _micros(F.col("_t"))
    scale = 1000 if unit == "ms" else 1
    if method == "backward":
        pick = F.col("_b")
    elif method == "forward":
        pick = F.col("_a")
    else:
        db = F.floor((t - _micros(F.col("_b._rt"))) / scale)
        da = F.floor((_micros(F.col("_a._rt")) - t) / scale)
        pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(db <= da, F.col("_b")).otherwise(F.col("_a"))
    got = work.where(~F.col("_right")).withColumn("_pick", pick).select("_row.*", *(F.col(f"_pick.{c}").alias(c) for c in extra))
    undated = both.where(F.col("_t").isNull() & ~F.col("_right")).select("_row.*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra))
    return got.unionByName(undated)


__all__ = ["INDEX", "METHODS", "asof_join"]
