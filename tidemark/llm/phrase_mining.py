"""Phrases of 2 to ``MOST_WORDS`` words that stand together more often than their parts, per language.

Texts (A-Z lower-cased) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those at
spaces and tabs into words.  All counts are per language, over all texts.

1. Dictionary encoding.  Each block of texts is written as numbers of its own
   word list; the lists meet, words with ``min_count`` occurrences in their
   language get ids (a word of another language is another word), and each block
   gets back the ids of its words.  A phrase with ``min_count`` occurrences has
   only such words, so pieces break at all others too.
2. Packing.  The window of ``MOST_WORDS`` ids from each position, cut at a break
   and filled with zeros, is one binary key of 5 bytes an id, big end first.  One
   such key serves all phrases that start there: they are its prefixes.
3. Sorting.  A task sorts its windows by radix, 16 bits at a time, and counts
   runs before the shuffle; then keys are range-partitioned, sorted within their
   range, and runs of each prefix length are counted.  A run that goes over a
   range's edge is counted in parts, which are summed.
4. Scores.  Each cut of a candidate of count a into parts of counts l and r gives
   floor(2000000 * a / (l + r)), in decimals of 38 digits; the lowest counts.
   Candidates within a longer candidate of 80 % of their count or more go.

No step depends on how often a word or a window stands: equal windows of a task
are one row, joins by word or part have one row of it on one side, and Spark can
split the other.  The first ``top`` of each language are found among the first
of each of ``SALTS`` shares of it.

Edge cases: a null text is empty; a null language is ``und``, as is a language of
that name.  Ids aren't used: repeated rows count each time.  An empty table gives
no phrases.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, written

MOST_WORDS, MIN_COUNT, TOP, DROP_PERCENT = 4, 30, 2000, 80
#: Bytes of an id: 10**12 words of ``min_count`` occurrences.
WIDTH = 5
BLOCK_BYTES = 4 << 20
#: Windows that a task holds before it sorts and counts them.
HELD_WINDOWS = 2_000_000
SALTS = 64
_BREAKS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_WORD = ~_BREAKS & ~np.isin(np.arange(256), list(b" \t"))


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, at, lang, word, n) of each block's word list, and one (block, sequence) of its texts as numbers.

    ``sequence`` packs 1 + the word's place in the list, with a 0 wherever words don't follow each other in a piece.
    """
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("sequence", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, block = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for b in batches:
            langs = b.column(0).dictionary_encode()
            names, of_doc = langs.dictionary, langs.indices.to_numpy()
            for a, e, c in tv.each(b.column(1), lower=True, limit=block_bytes, is_word=_WORD):
                if not len(c.starts):
                    continue
                word, at = c.word_codes()
                lang, n_langs = of_doc[a:e][c.doc_of()], max(1, len(names))
                listed, first, entry, times = np.unique(word * n_langs + lang, return_index=True, return_inverse=True, return_counts=True)
                raw = c.padded.tobytes()
                words = pa.array([raw[s:t] for s, t in zip(c.starts[first].tolist(), c.ends[first].tolist())], pa.binary())
                size = len(listed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, block)), pa.array(np.arange(size, dtype=np.int32)), names.take(pa.array(listed % n_langs)), words, pa.array(times.astype(np.int64)), pa.nulls(size, pa.binary())], schema=schema
                )
                broken = np.cumsum(_BREAKS[c.data], dtype=np.int64)
                apart = np.flatnonzero((np.diff(c.doc_of()) != 0) | (np.diff(broken[c.starts]) != 0)) + 1
                sequence = np.insert((entry + 1).astype(np.uint32), apart, 0)
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.binary(), pa.int64())), pa.array([press.compress(sequence.tobytes())], pa.binary())], schema=schema)
                block += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "block long, at int, lang string, word binary, n long, sequence binary")


def dictionary(listed: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, word, f, id, key) of the frequent words; ids are 1 and on with few gaps, ``key`` is the id as ``WIDTH`` bytes."""
    frequent = listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    placed = written(frequent.withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    parts = (placed.agg(F.max(part)).first()[0] or 0) + 1
    with_id = placed.select("lang", "word", "f", (local * F.lit(parts) + part + 1).alias("id"))
    out = with_id.withColumn("key", F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0")))
    out._tidemark_path = placed._tidemark_path
    return out


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by unsigned ``columns``, the first counting most: by 16 bits at a time from the last."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, int(column.max()).bit_length() if len(column) else 0, 16):
            digit = (column >> np.uint64(shift)).astype(np.uint16)[order]
            order = order[np.argsort(digit, kind="stable")]
    return order


def _windows(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """The ids at each position that has one and, while nothing breaks, at the ``most - 1`` after it."""
    at = np.flatnonzero(ids)
    ahead = np.concatenate([ids, np.zeros(most, np.uint64)])
    out = [ids[at]]
    for k in range(1, most):
        out.append(np.where(out[-1] > 0, ahead[at + k], np.uint64(0)))
    return out


def _counted(columns: list[np.ndarray]) -> pa.RecordBatch:
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    keys = np.concatenate([c[first].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :] for c in columns], axis=1)
    return pa.RecordBatch.from_arrays([_fixed(keys), pa.array(np.diff(np.append(first, len(order))).astype(np.int64))], names=["key", "n"])


def _fixed(keys: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, size = keys.shape
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])


def window_keys(coded: DataFrame, most: int = MOST_WORDS, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """(key, n) of (sequence, at, id): windows as keys, those of a task's share counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held: list[list[np.ndarray]] = []
        for b in batches:
            for k in range(b.num_rows):
                sequence = np.frombuffer(unpress.decompress(b.column(0)[k].as_py()), np.uint32)
                table = np.zeros(int(sequence.max()) + 1, np.uint64)
                table[b.column(1)[k].values.to_numpy() + 1] = b.column(2)[k].values.to_numpy().astype(np.uint64)
                held.append(_windows(table[sequence], most))
                if sum(len(w[0]) for w in held) >= held_windows:
                    yield _counted([np.concatenate(x) for x in zip(*held)])
                    held.clear()
        if held:
            yield _counted([np.concatenate(x) for x in zip(*held)])

    return coded.mapInArrow(run, "key binary, n long")


def prefix_runs(keys: DataFrame, min_count: int, most: int = MOST_WORDS) -> DataFrame:
    """(key, n): runs of the prefixes of 2 words and more of sorted keys; short runs are left out unless they touch an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = tv.flat(b.column(0))
            rows, n = data.reshape(b.num_rows, -1), b.column(1).to_numpy()
            upto = np.concatenate([[0], np.cumsum(n)])
            differ = rows[1:] != rows[:-1]
            for words in range(2, most + 1):
                new = np.append(True, differ[:, : words * WIDTH].any(axis=1))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(rows))
                total = upto[last] - upto[first]
                keep = (total >= min_count) | (first == 0) | (last == len(rows))
                keep &= rows[first, (words - 1) * WIDTH : words * WIDTH].any(axis=1)  # the window goes that far
                if keep.any():
                    yield pa.RecordBatch.from_arrays([_fixed(rows[first[keep], : words * WIDTH]), pa.array(total[keep])], names=["key", "n"])

    return keys.mapInArrow(run, "key binary, n long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, most: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang", held_windows: int = HELD_WINDOWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, words, f) of all phrases of 1 to ``most`` words that stand ``min_count`` times, the dictionary, and (lang, n)."""
    every = written(blocks(docs, text_col, lang_col, block_bytes), "phrase-blocks")
    listed = every.where("word is not null").select("block", "at", "lang", "word", "n")
    totals = written(listed.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = dictionary(listed, min_count)
    ids = listed.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("got"))
    coded = every.where("sequence is not null").select("block", "sequence").join(ids, "block")
    keys = written(window_keys(coded.select("sequence", F.col("got.at").alias("at"), F.col("got.id").alias("id")), most, held_windows), "phrase-windows")
    drop_written(every)
    placed = keys.repartitionByRange("key").sortWithinPartitions("key")
    runs = prefix_runs(placed, min_count, most).groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    found = runs.select("key", (F.length("key") / WIDTH).cast("int").alias("words"), "f").unionByName(words.select("key", F.lit(1).alias("words"), "f"))
    out = written(found, "phrase-counts")
    drop_written(keys)
    return out, words, totals


def _part(key: str, first: Column | int, words: Column | int) -> Column:
    """``words`` ids of a key from the one at ``first`` (0 and on)."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(F.col(key), as_col(first) * WIDTH + 1, as_col(words) * WIDTH)


def scored(counts: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(key, words, a, l, r, score) of all phrases of two words and more: the cut with the lowest score, then the first."""
    cand = counts.where("words > 1")
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), _part("key", 0, F.col("cut")).alias("part")), F.struct(F.lit(1).alias("side"), _part("key", F.col("cut"), F.col("words") - F.col("cut")).alias("part")))
    parts = cuts.select("key", "words", F.col("f").alias("a"), "cut", F.explode(sides).alias("s")).select("key", "words", "a", "cut", "s.side", "s.part")
    met = parts.join(counts.select(F.col("key").alias("part"), F.col("f").alias("part_f")), "part")
    pick = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("part_f")))
    wide = met.groupBy("key", "words", "a").agg(*(pick(k, s).alias(f"f{k}{s}") for k in range(1, most) for s in (0, 1)))
    score = lambda k: F.expr(f"cast(floor(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) / (cast(f{k}0 as decimal(19,0)) + f{k}1)) as bigint)")
    best = F.array_min(F.filter(F.array(*(F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")) for k in range(1, most))), lambda x: x["score"].isNotNull()))
    return wide.select("key", "words", "a", best.alias("best")).select("key", "words", "a", "best.l", "best.r", "best.score")


def without_parts(cand: DataFrame, counts: DataFrame, percent: int = DROP_PERCENT) -> DataFrame:
    """The candidates that no longer candidate of ``percent`` % of their count or more contains."""
    longer = counts.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inside = longer.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size")))).select(_part("key", F.col("first"), F.col("size")).alias("key"), "f")
    most = inside.groupBy("key").agg(F.max("f").alias("longest"))
    return cand.join(most, "key", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("a"))).drop("longest")


def spelled(cand: DataFrame, words: DataFrame) -> DataFrame:
    """Adds lang and phrase to candidates."""
    at = cand.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda k: F.substring(F.col("key"), k * WIDTH + 1, F.lit(WIDTH)))).alias("pos", "part"))
    met = at.join(words.select(F.col("key").alias("part"), "lang", "word"), "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"].cast("string")), " ")
    return cand.join(met.groupBy("key").agg(F.first("lang").alias("lang"), text.alias("phrase")), "key")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, most: int = MOST_WORDS, top: int = TOP, drop_percent: int = DROP_PERCENT, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counts, words, totals = phrase_counts(docs, min_count, most, text_col, lang_col, **options)
    rows = spelled(without_parts(scored(counts, most), counts, drop_percent), words)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
