"""Removing repeated passages: bucket-pointer refinement over sampled suffixes.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
earlier, in a document with a smaller id or before in the same one.

Initial buckets.  Of the ``GRAM``-byte strings within each window of LENGTH
bytes the one with the least hash is the window's anchor (leftmost among equal
ones), so equal windows have equal anchors at equal offsets.  Consecutive
windows with one anchor form a run.  Runs fall into buckets by their anchor's
gram; a bucket of one run holds no repeat and is left out.

Refinement.  Within a bucket, equal runs are told by their whole content (its
length and a 128-bit digest): all but the first are repeats
from end to end.  First runs of buckets with several
contents go on with their bytes.  There, windows start in buckets by their
first eight bytes and are refined by sorting on the pair (own bucket, bucket of
the position h further on), h = 8, 16, 32, and at last the offset that makes
LENGTH; each round reads the buckets that the round before has written.

Buckets may be very uneven.  Counting is combined before the shuffle, the joins
can be split by Spark, and a gram with more than ``HOT`` contents is dealt out
by window content instead, one window of each content per task.  A task refines
about a megabyte at once: whole grams, which are small, or windows of one key in
order of place, of which only the first of each content is held on.

Edge cases: null and empty texts have nothing to remove.  A null id counts as
larger than all others.  Rows with one id are taken in the order of their
texts; rows with equal id and text are one document and get equal results.
Extra columns are neither read nor returned.  Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, written

LENGTH, GRAM = 100, 40
HOT = 1024
#: Runs held by a task before they are passed on.
HELD_RUNS = 400_000
#: Bytes that are refined at once.
HELD_BYTES = 1 << 20
#: Window contents that a task remembers to combine repeats before the shuffle.
HELD_WINDOWS = 50_000


def runs(c: tv.Chunk, length: int = LENGTH, gram: int = GRAM, content: bool = True) -> tuple[np.ndarray, ...]:
    """(gram hash, two content hashes, document, first window, windows) of each run of the chunk; or the gram hash alone."""
    n, none = len(c.data), np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64), none, none, none
    at = np.arange(n - gram + 1)
    hashes = c.rolling(gram)
    bits = np.uint64((1 << max(20, n.bit_length())) - 1)
    least = (hashes & ~bits) | at.astype(np.uint64)
    width, k = length - gram + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if width > k:
        least = np.minimum(least[: k - width], least[width - k :])
    long = np.diff(c.off) >= length
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, c.off[:-1][long], 1)
    np.add.at(edge, c.off[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge, dtype=np.int8)[: n - length + 1])
    anchor = (least[window] & bits).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(new)
    first, count = window[start], np.diff(np.append(start, len(window)))
    doc = np.searchsorted(c.off, first, "right") - 1
    gram_hash, ends = hashes[anchor[start]], first + count - 1 + length
    if not content:
        return (gram_hash,)
    del hashes, least, edge, window, anchor, new
    return gram_hash, *_contents(c, first, ends), doc, first - c.off[doc], count


def _contents(c: tv.Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span's digest."""
    raw = memoryview(c.padded)
    found = b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist()))
    pair = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): n is the number of runs, or 2 for more, as far as each task has combined them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return _batch([keys.view(np.int64), np.minimum(n, 2).astype(np.int32)], ["gram", "n"])

        for b in batches:
            for _, _, c in tv.each(b.column(0), lower=False):
                held.append(runs(c, content=False)[0])
                if sum(map(len, held)) >= HELD_RUNS:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "gram long, n int")


def all_runs(docs: DataFrame) -> DataFrame:
    names = ["gram", "content", "again", "doc", "p", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for a, e, c in tv.each(b.column(1), lower=False):
                gram, content, again, doc, p, n = runs(c)
                yield _batch([gram.view(np.int64), content.view(np.int64), again.view(np.int64), ids[a:e][doc], p.astype(np.int32), n.astype(np.int32)], names)

    return docs.select("doc", "text").mapInArrow(run, "gram long, content long, again long, doc long, p int, n int")


def packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield _batch([b.column(0), pa.array([press.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc", "packed"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, packed binary")


def _window_keys(data: bytes) -> np.ndarray:
    c = tv.Chunk(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)
    return c.rolling(LENGTH).view(np.int64)


def bucket_bytes(texts: DataFrame, wanted: DataFrame, hot_contents: int = HOT) -> DataFrame:
    """(key, doc, p, bytes, again): what meets under a key is to be compared; ``again`` marks windows found to be repeats on the way."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("p", "n", "gram", "contents")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("p", pa.int32()), ("bytes", pa.binary()), ("again", pa.bool_())])
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return made

        for b in batches:
            hot: dict[int, bytes] = {}
            docs = b.column(0).to_numpy()
            for k in np.argsort(docs, kind="stable").tolist():
                doc, text = int(docs[k]), unpress.decompress(b.column(1)[k].as_py())
                for r in sorted(b.column(2)[k].as_py(), key=lambda r: r["p"]):
                    p, n, gram = r["p"], r["n"], r["gram"]
                    part = text[p : p + n - 1 + LENGTH]
                    if r["contents"] <= hot_contents:
                        rows.append((gram, doc, p, part, False))
                    else:
                        for i, key in enumerate(_window_keys(part).tolist()):
                            w = part[i : i + LENGTH]
                            if hot.get(key) == w:
                                rows.append((key ^ doc, doc, p + i, b"", True))
                            else:
                                if len(hot) < HELD_WINDOWS:
                                    hot.setdefault(key, w)
                                rows.append((key, doc, p + i, w, False))
                    if len(rows) >= 4096:
                        yield out()
            if rows:
                yield out()

    return texts.join(per_doc, "doc").select("doc", "packed", "runs").mapInArrow(run, "key long, doc long, p int, bytes binary, again boolean")


def refine(key: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of each window of ``length`` bytes within a row: windows share a bucket if key and bytes are equal.

    ``offsets`` bound the rows within ``data``.
    """
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))  # bytes from here to the row's end
    at = np.flatnonzero(left >= 8)
    left = left[at].astype(np.int32)
    gram = np.zeros(len(at), np.uint64)
    for k in range(8):
        gram |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
    own = np.repeat(np.unique(key, return_inverse=True)[1].astype(np.uint32), size)[at]
    pair = _dense(gram).astype(np.uint64) | own.astype(np.uint64) << np.uint64(32)
    del gram, own
    bucket = np.zeros(len(data), np.uint32)
    bucket[at] = _dense(pair)
    done = 8
    while done < length:
        step = min(done, length - done)
        keep = left >= done + step
        at, left = at[keep], left[keep]
        # read all before writing any: a round refines by the buckets of the round before
        fresh = _dense(bucket[at].astype(np.uint64) << np.uint64(32) | bucket[at + step].astype(np.uint64))
        bucket[at] = fresh
        done += step
    return at, bucket[at]


def _dense(values: np.ndarray) -> np.ndarray:
    """Each value's rank among the distinct ones."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    rank = np.zeros(len(values), np.uint32)
    rank[1:] = np.cumsum(ranked[1:] != ranked[:-1], dtype=np.uint32)
    out = np.empty(len(values), np.uint32)
    out[order] = rank
    return out


def _repeats(rows: pa.Table) -> pa.RecordBatch:
    """Merged byte ranges of the windows that aren't the first of their bucket."""
    key, doc, p = (rows.column(k).to_numpy() for k in range(3))
    data, offsets = tv.flat(rows.column(3).combine_chunks())
    again = rows.column(4).to_numpy()
    at, bucket = refine(key, data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    row = np.searchsorted(offsets, at, "right") - 1
    where_doc, where = doc[row], p[row] + at - offsets[row]
    order = np.lexsort((where, where_doc, bucket))
    bucket, where_doc, where = bucket[order], where_doc[order], where[order]
    later = np.zeros(len(bucket), bool)
    later[1:] = bucket[1:] == bucket[:-1]
    d, s = np.concatenate([where_doc[later], doc[again]]), np.concatenate([where[later], p[again]])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(d))[: len(start)] - 1
    return _batch([d[start].astype(np.int64), s[start].astype(np.int32), (s[last] + LENGTH).astype(np.int32)], ["doc", "lo", "hi"])


def resolved(buckets: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc, lo, hi) of repeats among the bucket bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, now = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            starts = np.flatnonzero(np.append(now is None or keys[0] != now, keys[1:] != keys[:-1]))
            upto = np.append(0, np.cumsum(pa.compute.binary_length(b.column(3)).to_numpy() + 24))
            # rows are taken up to the next key's first or as many as fill the piece, which is then cut
            a = 0
            while a < b.num_rows:
                full = max(a + 1, int(np.searchsorted(upto, upto[a] + max(0, held_bytes - size), "right")) - 1)
                cut = starts[np.searchsorted(starts, full, "right") - 1] if len(starts) and starts[0] <= full < b.num_rows else None
                if full >= b.num_rows:
                    cut = b.num_rows
                elif cut is None or cut < a or (cut == a and not held):
                    cut = full  # within one key
                if cut > a:
                    held.append(b.slice(a, cut - a))
                    size += int(upto[cut] - upto[a])
                    now = keys[cut - 1]
                a = cut
                if a < b.num_rows:
                    rows = pa.Table.from_batches(held)
                    yield _repeats(rows)
                    held = [_firsts(rows, now)] if keys[a] == now else []
                    size = sum(x.nbytes for x in held)
        if held:
            yield _repeats(pa.Table.from_batches(held))

    return buckets.repartition("key").sortWithinPartitions("key", "doc", "p").mapInArrow(run, "doc long, lo int, hi int")


def _firsts(rows: pa.Table, key: int) -> pa.RecordBatch:
    """Of the rows of a key the first of each content: all that later ones have to be compared with."""
    own = rows.filter(pa.compute.equal(rows.column(0), key)).combine_chunks()
    seen: dict[bytes, int] = {}
    for k, x in enumerate(own.column(3).to_pylist()):
        if x:
            seen.setdefault(x, k)
    return own.take(pa.array(list(seen.values()), pa.int64())).combine_chunks().to_batches()[0] if seen else own.slice(0, 1).combine_chunks().to_batches()[0]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc): doc is a long that orders documents as the ids do and tells them apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    plain = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    if plain and not each.where("n > 1 or id is null").limit(1).count():
        return rows.withColumn("doc", F.col("id").cast("long"))
    distinct = rows.select("id", "text").distinct().orderBy(F.asc_nulls_last("id"), "text")
    numbers = written(distinct.withColumn("doc", F.monotonically_increasing_id()).select("id", "doc", F.sha2("text", 256).alias("digest")), "doc-numbers")
    out = rows.withColumn("digest", F.sha2("text", 256)).alias("r").join(numbers.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.digest") == F.col("k.digest")))
    return written(out.select("r.id", "text", "doc"), "numbered")


def removed_ranges(docs: DataFrame, hot_contents: int = HOT, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc, lo, hi): byte ranges to remove, which may overlap. ``docs``: doc, text."""
    repeated = written(gram_counts(docs).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    alive = written(all_runs(docs).join(repeated, "gram"), "runs")
    same = ["content", "again", "n"]
    firsts = written(alive.groupBy(*same).agg(F.min(F.struct("doc", "p", "gram")).alias("first")).select(*same, "first.*"), "first-runs")
    several = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    wanted = written(firsts.join(several, "gram").select("doc", "p", "n", "gram", "contents"), "open-runs")
    whole = alive.join(firsts.select(*same, F.col("doc").alias("d0"), F.col("p").alias("p0")), same).where("doc <> d0 or p <> p0")
    whole = written(whole.select("doc", F.col("p").alias("lo"), (F.col("p") + F.col("n") - 1 + LENGTH).cast("int").alias("hi")), "whole-runs")
    for t in (repeated, alive, firsts):
        drop_written(t)
    part = written(resolved(bucket_bytes(packed(docs), wanted, hot_contents), held_bytes), "repeats")
    drop_written(wanted)
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot_contents: int = HOT, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary, the remaining bytes) if asked for."""
    rows = _numbered(docs, id_col, text_col)
    ranges = removed_ranges(rows, hot_contents, held_bytes).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = _with_id(rows.select("id", "doc", "text")).join(ranges, "doc", "left").select("id", "packed", "ranges")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[tuple] = []
            lists = b.column(2)
            off, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            lo, hi = (lists.values.field(k).to_numpy() for k in (0, 1))
            for i, data in enumerate(b.column(1).to_pylist()):
                text = unpress.decompress(data)
                keep, spans = text, 0
                if valid[i] and off[i + 1] > off[i]:
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, lo[off[i] : off[i + 1]], 1)
                    np.add.at(edge, hi[off[i] : off[i + 1]], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    keep = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), len(text) - len(keep), spans, hashlib.sha256(keep).hexdigest(), keep))
            cols = list(zip(*out)) if out else [[]] * 5
            arrays = [b.column(0), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[4], pa.binary())] if with_text else []), names=names[: 5 + with_text])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _with_id(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield _batch([b.column(0), b.column(1), pa.array([press.compress((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], ["id", "doc", "packed"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, doc long, packed binary")
