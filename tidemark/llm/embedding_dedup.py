"""Near-duplicate vectors by random-hyperplane signatures, exact cosines and components.

A table takes ``bits`` hyperplanes; the signs of a vector's products with them
are its key in that table.  Vectors meet where keys agree, and every pair that
meets has its cosine taken in double precision.  The number of bits follows the
number of vectors (groups of about 16), the number of tables follows from the
bits: a pair at the threshold is missed with probability ``miss`` at most.

Equal vectors form one class with a multiplicity and enter once.  A group is
cut into blocks, a task compares two blocks; a pair counts in the first table
in which it meets.  A task returns numbers of links per class and the links
that join two parts of its own rows, never its pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing: 0 links, own component, kept.  A row without id
counts as a neighbour, has a null component and is kept.  Rows with one id are
vectors of their own that are linked with one another's components.  Vectors of
different lengths never link.  Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, named_ids, numbered_ids, written
from .components import components

BLOCK = 512
GROUP = 16
MISS = 0.002


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = max(4, round(math.log2(max(n, 1) / GROUP + 1)))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log(1 - agree**bits))


@lru_cache(maxsize=8)
def planes(size: int, bits: int, tables: int, seed: int = 29) -> np.ndarray:
    return np.random.default_rng([seed, size, bits, tables]).standard_normal((size, bits * tables))


def keys_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) integer keys of unit rows."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _compare(x: np.ndarray, keys: np.ndarray, table: int, own: np.ndarray, pair: tuple[int, int], ids: np.ndarray, times: np.ndarray, threshold: float):
    left = np.flatnonzero(own == pair[0])
    right = left if pair[0] == pair[1] else np.flatnonzero(own == pair[1])
    i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
    i, j = left[i], right[j]
    fresh = (ids[j] > ids[i]) if pair[0] == pair[1] else np.ones(len(i), bool)
    i, j = i[fresh], j[fresh]
    if not len(i):
        return []
    for t in range(table):  # pairs that met in an earlier table are counted there; of close vectors hardly any stay
        apart = keys[i, t] != keys[j, t]
        i, j = i[apart], j[apart]
    linked = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    i, j = i[linked], j[linked]
    n = np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
    up = list(range(len(ids)))

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    join = []
    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            join.append((max(a, b), min(a, b)))
    at = {int(k) for k in np.flatnonzero(n)}
    joined = dict(join)
    return [(int(ids[k]), int(n[k]), int(ids[joined[k]]) if k in joined else None) for k in sorted(at | set(joined))]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept.

    Ids of any type that has an order; integers are fastest.
    """
    vectors, names = numbered_ids(vectors.select(id_col, vector_col), id_col)
    v = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    good = finite & (F.size(v) > 0) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("vector"))
    digest = F.sha2(F.concat_ws(",", F.transform("vector", lambda c: (c + F.lit(0.0)).cast("string"))), 256)
    rows = written(rows.withColumn("digest", F.when(F.col("vector").isNotNull(), digest)), "vectors")
    grouped = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"))
    # classes are numbered by a digest, as one may lack an id and one id may stand on two
    classes = written(grouped.withColumn("number", F.xxhash64("digest", F.lit(7))), "vector-classes")
    n = classes.count()
    bits, tables = plan(n, threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                sizes = np.diff(b.column(1).offsets.to_numpy())
                got = np.zeros((b.num_rows, tables), np.int64)
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    got[at] = keys_of(_units(_rows(b.column(1).take(pa.array(at)), size)), bits, tables)
                off = np.arange(0, b.num_rows * tables + 1, tables, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(got.ravel()))], names=["number", "keys"])

    signed = classes.select("number", "vector").mapInArrow(sign, "number long, keys array<long>")
    met = written(signed.select("number", F.posexplode("keys").alias("table", "key")), "vector-keys")
    groups = met.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = met.join(groups, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("number"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("table", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "number")
    full = dealt.join(classes.select("number", "times", "vector"), "number").select("table", "key", "lo", "hi", "own", "number", "times", "vector")
    sorted_ = full.repartition("table", "key", "lo", "hi").sortWithinPartitions("table", "key", "lo", "hi", F.size("vector"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(marks: np.ndarray, own: np.ndarray, ids: np.ndarray, times: np.ndarray, x: np.ndarray, keys: np.ndarray) -> list[tuple]:
            return _compare(x, keys, int(marks[0]), own, (int(marks[2]), int(marks[3])), ids, times, threshold)

        # a group's vectors have one length: it is part of what groups are sorted by
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple] = []
            sizes = pa.compute.list_value_length(b.column(7)).to_numpy()
            spans = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), b.num_rows]
            for p, q in zip(spans, spans[1:]):
                part = b.slice(p, q - p)
                x = _units(_rows(part.column(7), int(sizes[p])))
                marks = np.stack([*(part.column(k).to_numpy() for k in range(4)), sizes[p:q]], axis=1)
                columns = (marks, *(part.column(k).to_numpy() for k in (4, 5, 6)), x, keys_of(x, bits, tables))
                cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), q - p]
                for k, (u, v) in enumerate(zip(cuts, cuts[1:])):
                    now = tuple(c[u:v] for c in columns)
                    if k == 0 and held and (held[-1][0][-1] == marks[0]).all():
                        held.append(now)
                    else:
                        if held:
                            whole = held[0] if len(held) == 1 else tuple(np.concatenate(c) for c in zip(*held))
                            out += group(whole[0][0], *whole[1:]) if len(whole[0]) > 1 else []
                        held = [now]
            yield _found(out)
        if held:
            whole = held[0] if len(held) == 1 else tuple(np.concatenate(c) for c in zip(*held))
            yield _found(group(whole[0][0], *whole[1:]) if len(whole[0]) > 1 else [])

    found = written(sorted_.mapInArrow(compare, "number long, n long, joined long"), "vector-links")
    counts = found.groupBy("number").agg(F.sum("n").alias("n"))
    reps = classes.select("number", "rep")
    ends = found.where("joined is not null").join(reps, "number").select("joined", F.col("rep").alias("a")).join(reps.withColumnRenamed("number", "joined"), "joined").select("a", F.col("rep").alias("b"))
    by_class = classes.select("digest", "number", "rep", "times").join(counts, "number", "left")
    members = rows.select("vec_id", "digest").join(by_class, "digest", "left").select("vec_id", "rep", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).alias("n_links"))
    same_id = members.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    parts = components(ends.unionByName(same_id))
    out = members.join(parts, members["vec_id"] == parts["node"], "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    drop_written(met)
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return named_ids(out, names, "vec_id", "component_id")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["number", "n", "joined"])
