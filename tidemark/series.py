"""Order for DataFrames: series keys, dense indices, chunks with halos, carried values.

A series is all rows with equal ``partition_by``; its order is ``order_by``
(the last columns break ties).  Without ``partition_by`` the whole table is one
series: its dense index is made from a range partitioning and per-partition
counts, never in one task, and windows over it run per chunk of ``CHUNK`` rows
that carries as many neighbours as the window reaches (its halo).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 16
INDEX, CHUNK_COL = "idx", "_chunk"


@dataclass(frozen=True)
class SeriesKey:
    order_by: tuple[str, ...]
    partition_by: tuple[str, ...] = ()

    @classmethod
    def of(cls, order_by: str | Sequence[str], partition_by: str | Sequence[str] = ()) -> SeriesKey:
        many = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return cls(many(order_by), many(partition_by))


def materialised(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a Parquet table in the shared folder (``spark.checkpoint.dir``), read back; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Lazy results may read an intermediate table as long as the application runs; then its file system deletes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in a single local JVM (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-work"
    return root.rstrip("/")


def with_index(df: DataFrame, key: SeriesKey) -> DataFrame:
    """Adds ``idx``: 0, 1, 2 ... along each series."""
    if key.partition_by:
        return df.withColumn(INDEX, (F.row_number().over(W.partitionBy(*key.partition_by).orderBy(*key.order_by)) - 1).cast("long"))
    # the sample that cuts the ranges may differ when they are computed anew: the sorted rows are written once
    placed = df.repartitionByRange(*key.order_by).sortWithinPartitions(*key.order_by).withColumn("_id", F.monotonically_increasing_id())
    placed = materialised(placed.withColumn("_part", F.shiftright("_id", 33)), "ordered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    local = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(counts), "_part").withColumn(INDEX, (local + F.col("_before")).cast("long")).drop("_id", "_part", "_before")


def chunked(df: DataFrame, before: int, after: int = 0, chunk: int | None = None) -> DataFrame:
    """Adds ``_chunk`` and ``_own``; a row within ``before``/``after`` of another chunk is given to that one too.

    ``df`` has ``idx``. Rows with ``_own`` false only serve as neighbours.
    """
    size = chunk or max(CHUNK, 4 * (before + after))
    own = F.floor(F.col(INDEX) / size)
    lo, hi = F.floor((F.col(INDEX) - after) / size), F.floor((F.col(INDEX) + before) / size)
    spread = df.withColumn(CHUNK_COL, F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("long")), hi)))
    return spread.withColumn("_own", F.col(CHUNK_COL) == own)


def over_rows(df: DataFrame, key: SeriesKey, before: int, after: int, columns: dict[str, callable], chunk: int | None = None) -> DataFrame:
    """Adds window columns whose frames reach at most ``before`` rows back and ``after`` rows on.

    Each value of ``columns`` takes an ordered WindowSpec (without frame) and returns a Column.  ``df`` has ``idx``.
    """
    parts = [*key.partition_by, CHUNK_COL]
    w = W.partitionBy(*parts).orderBy(INDEX)
    out = chunked(df, before, after, chunk)
    return out.withColumns({name: make(w) for name, make in columns.items()}).where("_own").drop(CHUNK_COL, "_own")


def carried(df: DataFrame, key: SeriesKey, values: dict[str, Column], backward: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Adds, per name, the latest non-null value at or before each row (``backward``: at or after).

    Two levels: within chunks, then the chunks' last values along the (short) series of chunks.
    """
    parts = list(key.partition_by)
    order = F.col(INDEX).desc() if backward else F.col(INDEX).asc()
    work = df.withColumn(CHUNK_COL, F.floor(F.col(INDEX) / chunk)).withColumns({f"_v_{n}": v for n, v in values.items()})
    w = W.partitionBy(*parts, CHUNK_COL).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    work = work.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(w) for n in values})
    pick = F.min_by if backward else F.max_by
    ends = work.groupBy(*parts, CHUNK_COL).agg(*(pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(INDEX))).alias(f"_e_{n}") for n in values))
    chunk_order = F.col(CHUNK_COL).desc() if backward else F.col(CHUNK_COL).asc()
    we = W.partitionBy(*(parts or [F.lit(0)])).orderBy(chunk_order).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumns({f"_p_{n}": F.last(f"_e_{n}", ignorenulls=True).over(we) for n in values}).select(*parts, CHUNK_COL, *(f"_p_{n}" for n in values))
    cond = [work[c].eqNullSafe(ends[c]) for c in parts] + [work[CHUNK_COL] == ends[CHUNK_COL]]
    for c in cond[1:]:
        cond[0] = cond[0] & c
    joined = work.join(ends, cond[0], "left")
    return joined.select(*(work[c] for c in df.columns), *(F.coalesce(f"_l_{n}", f"_p_{n}").alias(n) for n in values))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right`` where all keys are equal, null ones too."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`"))
    more = [c for c in right.columns if c not in keys]
    return left.alias("_l").join(right.alias("_r"), on).select(*(F.col(f"_l.`{c}`") for c in left.columns), *(F.col(f"_r.`{c}`") for c in more))


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Adds, per name, the sum of a column over the group's rows up to each one in ``order``, which is unique in a group.

    Rows are cut into ranges of (group, order) and summed within them; the ranges' totals are then summed along each
    group, a row per range.  So no task has a whole group.
    """
    groups = list(groups)
    placed = df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    placed = materialised(placed, "ranges")  # another run could cut the ranges elsewhere
    totals = placed.groupBy("_part", *groups).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", *groups, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    upto = W.partitionBy("_part", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    work = placed.withColumns({f"_w_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    met = joined(work, totals, ["_part", *groups])
    return met.select(*df.columns, *((F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))
