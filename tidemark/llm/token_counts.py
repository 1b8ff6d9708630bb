"""Token counts through a digest cache.

A text's count depends only on its content and on the tokenizer, so counts are
stored under (tokenizer digest, content digest), a folder per tokenizer.  A run
joins its documents' digests to the store, encodes each distinct missing content
once, appends the new counts and joins them back.  Copies of one content are
brought together within tasks before either join.

Contents are normalised before they are digested, as far as the tokenizer file
says that it does the same: A-Z to a-z, and runs of ASCII white space to one
space.  A text that spells one of the file's added tokens in any case, which
the tokenizer looks for before it normalises, is digested as it is.

Within an encoding task, counts are also remembered by word: the tokenizer
never joins characters across white space, so a text's count is the sum of its
words' counts.  ``word_separable`` checks that of the tokenizer file; others
are encoded text by text.

Edge cases: null text counts as empty (0 bytes, 0 tokens).  Null ids stay.
Repeated rows get a row each.  An empty table gives an empty result.  Extra
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import packed_ids, shared_dir, written

#: Remembered words per task; the memory is emptied when full, which costs time and never changes a count.
REMEMBERED = 150_000
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_digest(path: str) -> str:
    """Identifies what the counts depend on: the file and the library's version."""
    data = Path(path).read_bytes()
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    return hashlib.sha256(data + library.__version__.encode()).hexdigest()


def word_separable(path: str) -> bool:
    """True if white space is only ever a separator: it is in no token, and no step looks across it."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    splits = [s for s in steps if s.get("type") == "Split"]
    normal = {s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])}
    space_free = bool(splits) and splits[0]["behavior"] == "Removed" and splits[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in splits[0]["pattern"].get("Regex", "") and "|\\s" not in splits[0]["pattern"]["Regex"]
    return bool(space_free and normal <= {"NFC", "Replace", "Lowercase"} and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"]))


class Counter:
    def __init__(self, path: str):
        self.by_word: dict[bytes, int] = {}
        self.by_piece: dict[str, int] = {}
        self.separable = word_separable(path)
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.lowered = "Lowercase" in Path(path).read_text()
            self.lengths = lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            tok = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in tok.encode(texts, num_threads=1)]

    def _words(self, words: list[str]) -> list[int]:
        """Counts of single words. A run of Latin letters and the marks after it are always separate, so they are looked up apart."""
        parts = []
        for w in words:
            m = _SIMPLE.fullmatch(w) if self.lowered else None
            parts.append((m[1].lower(), m[2]) if m else (w,))
        new = list({p for ps in parts for p in ps if p not in self.by_piece})
        if len(self.by_piece) + len(new) > REMEMBERED:
            self.by_piece.clear()
            new = list({p for ps in parts for p in ps})
        for a in range(0, len(new), 4096):
            self.by_piece.update(zip(new[a : a + 4096], self.lengths(new[a : a + 4096])))
        return [sum(self.by_piece[p] for p in ps) for ps in parts]

    def counts(self, column: pa.Array) -> np.ndarray:
        if not self.separable:
            texts = [t or "" for t in column.to_pylist()]
            return np.array([n for a in range(0, len(texts), 16) for n in self.lengths(texts[a : a + 16])], np.int64)
        out = [np.zeros(0, np.int64)]
        for _, _, c in tv.each(column, lower=False):
            where, at = c.word_codes()
            if len(self.by_word) + len(at) > REMEMBERED:
                self.by_word.clear()
            raw = c.data.tobytes()
            words = [raw[s:e] for s, e in zip(c.starts[at].tolist(), c.ends[at].tolist())]
            missing = [w for w in words if w not in self.by_word]
            self.by_word.update(zip(missing, self._words([w.decode() for w in missing])))
            each = np.fromiter((self.by_word[w] for w in words), np.int64, len(words))
            total = np.concatenate([[0], np.cumsum(each[where])])
            out.append(total[c.first[1:]] - total[c.first[:-1]])
        return np.concatenate(out)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


STORE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def normaliser(path: str) -> Callable[[bytes], bytes]:
    """What makes texts of equal counts equal, as far as the tokenizer file says that it does the same itself."""
    if not path.endswith(".json"):
        return lambda text: text
    spec = json.loads(Path(path).read_text())
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    lowers, spaces = any(s["type"] == "Lowercase" for s in steps), any(s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " " for s in steps)
    if not lowers or not {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"} or any(t.get("normalized") for t in spec["added_tokens"]):
        return lambda text: text
    special = [t["content"].lower().encode() for t in spec["added_tokens"]]

    def normal(text: bytes) -> bytes:
        out = text.lower()  # A-Z only
        if any(t in out for t in special):
            return text
        if spaces and out:
            out = (b" " if out[:1].isspace() else b"") + b" ".join(out.split()) + (b" " if out[-1:].isspace() else b"")
        return out

    return normal


def _digested(rows: DataFrame, path: str, with_text: bool) -> DataFrame:
    """(id, n_bytes, digest) or (digest, text) of (id, text): one narrow pass."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = normaliser(path)
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            digests = pa.array([hashlib.sha256(normal(t)).digest() for t in texts], pa.binary())
            if with_text:
                yield pa.RecordBatch.from_arrays([digests, b.column(1)], names=["digest", "text"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), digests], names=["id", "n_bytes", "digest"])

    return rows.mapInArrow(run, "digest binary, text string" if with_text else f"id {kind}, n_bytes long, digest binary")


def count_tokens(docs: DataFrame, tokenizer_path: str, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens (long).

    ``store`` is the cache's folder, on storage that the cluster shares; by default a new one under
    ``spark.checkpoint.dir``, so that nothing is kept between calls.
    """
    spark = docs.sparkSession
    store = store or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = _digested(rows, tokenizer_path, with_text=False)
    contents = _digested(rows, tokenizer_path, with_text=True)
    if _exists(spark, store):
        marks = written(marks, "token-digests")
        known = spark.read.schema(STORE_SCHEMA).parquet(store).where(F.col("tokenizer") == version).select("digest")
        contents = contents.join(marks.select("digest").distinct().join(known, "digest", "left_anti"), "digest", "left_semi")
    contents = contents.groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for b in batches:
            got = counter.counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64()), pa.array([version] * len(got), pa.string())], names=["digest", "n_tokens", "tokenizer"])

    contents.mapInArrow(run, STORE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(store)
    # one run may lose a race to another on the same store; equal digests have equal counts
    counts = spark.read.schema(STORE_SCHEMA).parquet(store).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    packs = packed_ids(marks.select("digest", F.struct("id", "n_bytes").alias("row")))
    met = packs.join(counts, F.col("key") == F.col("digest")).select(F.explode("ids").alias("row"), "n_tokens")
    return met.select(F.col("row.id").alias(id_col), F.col("row.n_bytes").alias("n_bytes"), "n_tokens")
