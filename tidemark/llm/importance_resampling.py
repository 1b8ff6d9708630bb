"""Importance resampling towards a target distribution, over hashed word features.

Features of a text are its runs of 1 to ``n`` consecutive words (lower-cased
A-Z, letters, digits and all characters above ASCII), each in one of
``BUCKETS`` buckets by CRC-32.  With S features in all documents, s of them in
a bucket, and T and t the same for the target texts, a bucket gains

    floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS))))

and a document's weight is the sum of gains over its features.  Documents with
``MIN_WORDS`` words are ordered by weight plus Gumbel noise, of which the first
``percent`` are a draw without replacement with chances by exp(weight).

Identical texts are collapsed: texts are grouped whole, features and weight are
computed once for each, and the counts of a bucket take a text as often as it
stands.  Weights then go back to the documents by text digest, and the noise is
each document's own.  Copies of one text are brought together within tasks
before they are joined, so a text of a third of all rows is a few rows there.
The order is made by ranges, in no single task; the target's and the corpus's
counts are ``BUCKETS`` numbers each, whatever the sizes.

Edge cases: null and empty texts have no features, weight 0, and are never
drawn.  A null id makes its noise as an empty one and comes last among ties.
Repeated rows are drawn apart, but share their noise.  Empty tables: no rows,
or (empty target) gains from the corpus alone.  Extra columns are neither read
nor returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, packed_ids, ranked, written

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
_CODES = np.arange(256)
WORD_BYTES = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES > 127)


def _buckets(c: tv.Chunk, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of a chunk."""
    word, at = c.word_codes()
    raw = c.padded.tobytes()
    words = [raw[s:e] for s, e in zip(c.starts[at].tolist(), c.ends[at].tolist())]
    doc = c.doc_of()
    docs, found = [], []
    run = word.astype(np.int64)
    for k in range(1, n + 1):
        here = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
        if k > 1:
            longer = np.zeros(len(word), np.int64)
            longer[here] = tv.dense(run[here] * max(1, len(words)) + word[here + k - 1])
            run = longer
        _, first, code = np.unique(run[here], return_index=True, return_inverse=True)
        text = (b" ".join(words[w] for w in word[i : i + k].tolist()) for i in here[first].tolist())
        docs.append(doc[here])
        found.append(np.array([zlib.crc32(x) % buckets for x in text], np.int64)[code] if len(code) else code)
    return np.concatenate(docs), np.concatenate(found)


def features(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(digest, copies, n_words, n_features, bucket, times) of (text, copies, digest): a text's features, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, c in tv.each(b.column(0), lower=True, is_word=WORD_BYTES):
                doc, bucket = _buckets(c, n, buckets)
                pair, times = np.unique(doc * buckets + bucket, return_counts=True)
                ends = np.searchsorted(pair // buckets, np.arange(c.n_docs + 1))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(2).slice(a, e - a), b.column(1).slice(a, e - a), pa.array(c.n_words.astype(np.int64)), pa.array(np.bincount(doc, minlength=c.n_docs).astype(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array((pair % buckets).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    names=["digest", "copies", "n_words", "n_features", "bucket", "times"],
                )

    return texts.select("text", "copies", "digest").mapInArrow(run, "digest binary, copies long, n_words long, n_features long, bucket array<int>, times array<int>")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, copies, digest): each text once; equal texts meet within tasks before they are shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", _digest("text"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket stands in all texts, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            np.add.at(total, lists.flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(np.int64) * np.repeat(b.column(0).to_numpy(), size))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    counts = found.select("copies", "bucket", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    s_all, t_all, k = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus, target)]


def weights(found: DataFrame, gain: list[int]) -> DataFrame:
    """(digest, n_words, n_features, weight) of each text; ``gain`` has a number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = np.array(gain, np.int64)
        for b in batches:
            lists = b.column(3)
            upto = np.concatenate([[0], np.cumsum(each[lists.flatten().to_numpy()] * b.column(4).flatten().to_numpy())])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array((upto[ends[1:]] - upto[ends[:-1]]).astype(np.int64))], names=["digest", "n_words", "n_features", "weight"])

    return found.select("digest", "n_words", "n_features", "bucket", "times").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score (long) and rank (long: 1, 2, 3 ... of the drawn rows, else null)."""
    found = written(features(distinct_texts(docs, text_col), n, buckets), "text-features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(distinct_texts(target, target_text_col), n, buckets), buckets))
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    copies = packed_ids(rows.select(_digest("text").alias("key"), "id"))
    # of a text's many packs and its one weight, Spark may split the packs
    joined = copies.join(weights(found, gain).withColumnRenamed("digest", "key"), "key").select(F.explode("ids").alias("id"), "n_words", "n_features", "weight")
    scored = joined.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    short = F.col("n_words") < min_words
    placed = ranked(scored.withColumn("short", short), F.col("short"), F.col("score").desc(), F.asc_nulls_last("id"), name="resampled")
    drop_written(found)
    drawn = percent * placed.where(~F.col("short")).count() // 100
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is drawn; rows without id are left out."""
    ids = resample(docs, target, id_col=id_col, **options).where("rank is not null").select(id_col).distinct()
    return docs.join(ids, id_col, "left_semi").select(*docs.columns)
