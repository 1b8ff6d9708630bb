"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import gone_at_exit

_CLEANUP = {"spark_sql_classic_shuffleDependency_fileCleanup_enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in a single local JVM (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/tidemark-shared"
    return found.rstrip("/")


@contextmanager
def configured(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the actions of a block; names with "_" for ".", as they were before at its end."""
    names = {k: k.replace("_", ".") for k in settings}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, settings[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: the lineage is cut, and losing an executor loses nothing.

    Spark gives back the disk of the shuffles behind it at once.  The table goes with ``drop_written``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with configured(spark, **_CLEANUP, **settings):
        df.write.parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that no plan reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Ids that share a key in one row, at most.
PACK = 4096
#: Rows that a task holds to bring the ids of one key together.
HELD_ROWS = 1 << 17


def packed_ids(rows: DataFrame) -> DataFrame:
    """(key binary, id) as (key, ids): each task brings ids of one key together, so that a key of very many rows makes few.

    ``explode`` gives the rows back; an id may be null, a key may not.
    """
    names = rows.columns

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        code = whole.column(0).combine_chunks().dictionary_encode()
        order = np.argsort(code.indices.to_numpy(), kind="stable")
        ranked = code.indices.to_numpy()[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        within = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
        start = np.flatnonzero(within % PACK == 0)
        ids = pa.ListArray.from_arrays(pa.array(np.append(start, len(ranked)), pa.int32()), whole.column(1).combine_chunks().take(pa.array(order)))
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(ranked[start])), ids], names=["key", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                yield packed(held)
                held.clear()
        if held:
            yield packed(held)

    return rows.mapInArrow(run, f"key binary, ids array<{rows.schema[names[1]].dataType.simpleString()}>")


def ranked(rows: DataFrame, *order: Column, name: str = "ranked") -> DataFrame:
    """Adds ``place``, 1, 2, 3 ... in the order given: ranges are sorted apart, then their sizes are summed.

    The rows are written once, as another run could cut the ranges elsewhere; the sizes are a row per range.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, name)
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    before, upto = [], 0
    for r in sizes:
        before.append((r["_range"], upto))
        upto += r["n"]
    starts = spark.createDataFrame(before, "_range long, _before long")
    out = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_range"), 33) + 1
    return out.withColumn("place", place).drop("_range", "_before", "_at")


def numbered_ids(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ids as longs in the ids' order, and the table (number, id) that tells them back; None where ids are integers.

    Null ids stay null.
    """
    if dict(rows.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        return rows, None
    ids = rows.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    names = ranked(ids, F.col("id"), name="id-numbers").select(F.col("place").alias("number"), "id")
    met = rows.join(names, rows[id_col] == names["id"], "left")
    return met.select(*(F.col("number").alias(c) if c == id_col else rows[c] for c in rows.columns)), names


def named_ids(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """The numbers of ``columns`` as the ids that they stand for."""
    for c in columns if names is not None else ():
        own = names.select(F.col("number").alias("_number"), F.col("id").alias("_id"))
        rows = rows.join(own, rows[c] == own["_number"], "left").select(*(F.col("_id").alias(x) if x == c else rows[x] for x in rows.columns))
    return rows
