"""A training corpus from raw documents: rules, near-duplicates, personal data, mixing, token ids.

Each stage works on all rows that the one before it kept and returns the
columns of ``documents``; the last returns doc_id with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash_dedup, mixing, pii, quality_rules, sentencepiece
from tidemark.llm.common import drop_written, ranked, written
from tidemark.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule of the default policy fails.

    Each row is judged by itself and in place: nothing is joined back, so repeated or null ids are no matter.
    """
    return quality_rules.keep_rows(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): the one with the least id.

    Rows without id, or that share one, get numbers first, in the order of ids (none last) and texts.
    """
    rows = docs.select(*COLUMNS)
    unique = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count() == 0
    name = "doc_id"
    if not unique:
        rows, name = ranked(rows, F.asc_nulls_last("doc_id"), F.col("text"), name="numbered"), "place"
    found = minhash_dedup.near_duplicates(rows, percent=80, id_col=name)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return rows.join(gone, name, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and disclosing terms replaced; n_chars follows."""
    return pii.sanitised(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids; a row per row of the mix."""
    return sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality), ("minhash_dedup", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("sentencepiece", token_ids)]
#: The near-duplicate, term and encoding stages can't be said in SQL; tests hold each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written to the shared folder and read back for the next."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, before, sf_dir), f"pipeline-{name}")
        drop_written(before)  # of the tables made here; documents stay
        before = docs
    return docs
