"""Near-duplicate documents by HyperMinHash.

A document is the set of its five-word shingles.  Its sketch has 128 buckets;
a bucket keeps, of the least hash that fell into it, the leading-zero count
and ten mantissa bits (16 bits in all).  An empty bucket borrows another's
register, tried in an order that depends on the bucket only.  Bands of five
registers propose documents; a collision-corrected Jaccard estimate screens the
proposals and the full sets decide.

Documents with the same set form one class and enter once.  In a band's group
each class first meets only the group's least class.  Groups that then still
hold several components are cut into blocks; a task holds two blocks, screens
the pairs across components, verifies those left on the full sets and lists
only links that join two components.  So every proposed link that could change
a component is looked at, and no group's pairs are ever listed.

Edge cases: null and empty texts have no shingles, link with nothing and stay.
A row without id links with nothing: its component is null and it is kept.
Rows with one id and different texts count as one node.  Extra columns are
neither read nor returned.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, named_ids, numbered_ids, written
from .components import components

WORDS = 5
BUCKETS, MANTISSA = 128, 10
BANDS, ROWS = 25, 5
#: The estimate's standard error is 0.04 at most; proposals this far below the threshold go unverified.
MARGIN = 0.16
_VALUE_BITS = 57
#: Classes of a group that are compared in one task, at most, with as many others.
BLOCK = 256
_PROBES = np.argsort(tv.mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(99)).reshape(BUCKETS, BUCKETS), axis=1)


def shingles(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its shingles; fewer words make one shingle."""
    out: list[np.ndarray] = []
    for _, _, c in tv.each(column, lower=True):
        hashes = c.word_hash()
        grams = tv.gram_hash(hashes, words)
        first = c.first.tolist()
        for d in range(c.n_docs):
            a, b = first[d], first[d + 1]
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                out.append(tv.gram_hash(hashes[a:b], b - a) ^ np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 128) registers of (leading zeros, mantissa) of each bucket's least value; a set without hashes gets zeros."""
    none = np.iinfo(np.uint64).max
    least = np.full((len(sets), BUCKETS), none, np.uint64)
    for row, hashes in zip(least, sets):
        np.minimum.at(row, (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), tv.mix(hashes) >> np.uint64(64 - _VALUE_BITS))
    full = least != none
    held = np.where(full, np.maximum(least, 1), 1)
    # the float's exponent is that of the integer unless rounding carried it to the next power of two
    exponent = np.frexp(held.astype(np.float64))[1].astype(np.uint64)
    exponent -= held < (np.uint64(1) << (exponent - np.uint64(1)))
    mantissa = ((held << (np.uint64(63) - (exponent - np.uint64(1)))) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    bits = ((np.uint64(_VALUE_BITS) - exponent) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    todo = ~full & full.any(axis=1)[:, None]
    for k in range(BUCKETS):
        if not todo.any():
            break
        r, j = np.nonzero(todo & full[:, _PROBES[:, k]])
        bits[r, j] = bits[r, _PROBES[j, k]]
        todo[r, j] = False
    bits[~full.any(axis=1)] = 0
    return bits


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of (n, 128) registers."""
    rows = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = tv.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.astype(np.int64)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree though the sets are disjoint, for set sizes n and m."""
    k = np.arange(_VALUE_BITS + 1)
    share = lambda size: np.diff((1 - 2.0 ** -k[:, None]) ** (np.maximum(size, 1)[None, :] / BUCKETS), axis=0)
    return (share(n) * share(m)).sum(axis=0) / (1 << MANTISSA)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    chance = chance_matches(n, m)
    return np.clip(((x == y).mean(axis=1) - chance) / (1 - chance), 0, 1)


_SIGNED = "doc_id long, n_shingles long, set_lo long, set_hi long, text_key long, sketch binary"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, set size, 128-bit digest of the set, 64-bit key of the text, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                sets = shingles(b.column(1))
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (flat, tv.mix(flat)))
                end = np.cumsum(n)
                lo, hi = (t[end] - t[end - n] for t in sums)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()), pa.array(n), pa.array(tv.mix(lo).view(np.int64)), pa.array(tv.mix(hi + n.astype(np.uint64)).view(np.int64)), b.column(2), pa.array([r.tobytes() for r in sketches(sets)], pa.binary())],
                    names=["doc_id", "n_shingles", "set_lo", "set_hi", "text_key", "sketch"],
                )

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key")).mapInArrow(run, _SIGNED)


def band_rows(classes: DataFrame) -> DataFrame:
    """(rep, band, key) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                keys = band_keys(_registers(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(keys.ravel())], names=["rep", "band", "key"])

    return classes.select("rep", "sketch").mapInArrow(run, "rep long, band int, key long")


def _registers(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(r, np.uint16) for r in column.to_pylist()], np.uint16).reshape(-1, BUCKETS)


def packed_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, sketch, packed): for the classes ``wanted`` (rep), one compressed text each; sets are made of it where they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([press.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["rep", "text_key", "packed"])

    texts = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key")).mapInArrow(run, "rep long, text_key long, packed binary")
    found = texts.join(classes.join(wanted, "rep"), ["rep", "text_key"])
    return found.groupBy("rep").agg(F.first("sketch").alias("sketch"), F.first("packed").alias("packed"))


def _sets(packed: list[bytes]) -> list[np.ndarray]:
    unpress = zstandard.ZstdDecompressor()
    return shingles(pa.array([unpress.decompress(x) for x in packed], pa.binary()))


def screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sizes and sketches allow a link."""
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
            near = estimate(_registers(b.column(2)), _registers(b.column(3)), n, m) >= percent / 100 - MARGIN
            near &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets have 100 * intersection >= percent * union."""
    side = lambda k: texts.select(F.col("rep").alias(k), F.col("packed").alias(f"x{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                x, y = _sets(b.column(2).to_pylist()), _sets(b.column(3).to_pylist())
                both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
                total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64) - both
                keep = pa.array(100 * both >= percent * total)
                yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


class _Parts:
    """Union-find over the components met in one group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of sets[i] & sets[j] for each pair: products of a 0/1 matrix over hashes that two sets share."""
    if len(i) < 400:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, 4096):
        at = (column >= a) & (column < a + 4096)
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[at], column[at] - a] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _joins(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links of one pair of blocks that join two components. Rows: band, own block, the two blocks, rep, part, sketch, packed text, set size."""
    band, pair = rows[0][0], (rows[0][2], rows[0][3])
    rep, part = (np.array([r[k] for r in rows], np.int64) for k in (4, 5))
    regs = np.array([np.frombuffer(r[6], np.uint16) for r in rows])
    n = np.array([r[8] for r in rows], np.int64)
    block = np.array([r[1] for r in rows])
    keys = band_keys(regs)
    left = np.flatnonzero(block == pair[0])
    right = left if pair[0] == pair[1] else np.flatnonzero(block == pair[1])
    found_i, found_j = [], []
    for i in left.tolist():
        others = right[(part[right] != part[i]) & ((rep[right] > rep[i]) if pair[0] == pair[1] else True)]
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        # a pair is looked at in the first band that it shares
        others = others[(keys[others] == keys[i]).argmax(axis=1) == band]
        if len(others):
            near = estimate(regs[others], regs[i][None, :], n[others], np.full(len(others), n[i])) >= percent / 100 - MARGIN
            found_j.append(others[near])
            found_i.append(np.full(int(near.sum()), i))
    if not found_i:
        return []
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return []
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    both = _intersections(_sets([rows[k][7] for k in used.tolist()]), where[: len(i)], where[len(i) :])
    linked = 100 * both >= percent * (n[i] + n[j] - both)
    parts, out = _Parts(), []
    for x, y in zip(i[linked].tolist(), j[linked].tolist()):
        a, b = parts.root(int(part[x])), parts.root(int(part[y]))
        if a != b:
            parts.up[max(a, b)] = min(a, b)
            out.append((int(rep[x]), int(rep[y])))
    return out


def joining_links(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, within the groups ``rows`` (key, n classes, band, rep, part)."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "band", "own", "rep", "part")
    full = dealt.join(texts, "rep")
    columns = ["key", "band", "own", "lo", "hi", "rep", "part", "sketch", "packed", "n_shingles"]
    sorted_ = full.select(*columns).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        mark = None
        out: list[tuple[int, int]] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                now = (r[0], r[3], r[4])
                if now != mark and held:
                    out += _joins(held, percent)
                    held = []
                mark = now
                held.append(r[1:])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = _joins(held, percent) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (long), component_id (least id reachable by links, null without id), kept.

    Ids of any type that has an order; integers are fastest.
    """
    docs, names = numbered_ids(docs.select(id_col, text_col), id_col)
    signed = written(signatures(docs, id_col, text_col), "signatures")
    of_set = ["set_lo", "set_hi"]
    full = signed.where("n_shingles > 0")
    linked = written(full.groupBy(*of_set).agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    classes = full.join(linked, of_set).where("doc_id = rep").groupBy(*of_set).agg(*(F.min(c).alias(c) for c in ("rep", "n_shingles", "text_key")), F.first("sketch").alias("sketch"))
    # an id may stand on rows of several texts: their classes meet in the id and count as linked
    classes = written(classes.drop(*of_set), "class-rows")
    bands = written(band_rows(classes), "bands")
    groups = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = written(bands.join(groups, "key"), "band-groups")
    drop_written(bands)
    texts = written(packed_texts(docs, classes.select("rep", "text_key", "sketch"), grouped.select("rep").distinct(), id_col, text_col).join(classes.select("rep", "n_shingles"), "rep"), "texts")
    stars = grouped.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(verified(screened(stars, classes, percent), texts, percent), "links")
    parts = parts_written = written(components(links), "components")
    own = lambda c: F.coalesce("component", c)
    labelled = grouped.join(parts, grouped["rep"] == parts["node"], "left").select("key", "n", "band", "rep", own("rep").alias("part"))
    several = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    open_groups = written(labelled.join(several, "key"), "open-groups")
    more = joining_links(open_groups, texts, percent)
    same_id = full.where("doc_id is not null").join(linked, of_set).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more).unionByName(same_id.where("a <> b")))
    for t in (linked, classes, grouped, texts, links, parts_written, open_groups):
        drop_written(t)
    out = signed.join(final, signed["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", own("doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return named_ids(out, names, "doc_id", "component_id")
