"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per text and stores what each rule
measured and, in one integer, which rules failed.  A policy is a named,
versioned mask over that integer, so changing a policy, or asking what one
rule does alone, reads the ledger and never the texts again.

Edge cases: a null or empty text has all measures 0 and fails ``few_words``.
A null id stays null.  Repeated rows get a row each.  Extra columns of the
input are neither read nor returned, whatever their names.  An empty table
gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_EXCLAIM = np.arange(256) == 33
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_NEWLINE = 10


@dataclass(frozen=True)
class Rule:
    """``fails`` is an integer expression over the measures; its bit is its place in ``RULES``."""

    name: str
    fails: str


#: Append only: a rule's bit must keep its meaning in stored ledgers.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * n_letters and n_letters > 0"),
    Rule("exclaiming", "100 * n_exclaims > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: name -> (version, mask). A new version gets a new name; old ones stay for replay.
POLICIES = {
    "base@1": mask("few_words", "repeated_words"),
    "web@1": mask(*BIT),
}
DEFAULT_POLICY = "web@1"


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    parts: list[list[np.ndarray]] = []
    for _, _, c in tv.each(column, lower=False):
        n, docs, words = c.n_docs, c.doc_of(), c.word_codes()[0]
        newline = np.flatnonzero(c.data == _NEWLINE)
        begin = np.unique(np.concatenate([c.off[:-1], newline + 1]))
        # a newline that ends a document opens an empty line, which has no word and is left out
        begin = begin[begin < len(c.data)]
        after = np.concatenate([begin[1:], [len(c.data)]]) if len(begin) else begin
        line_doc = np.searchsorted(c.off, begin, "right") - 1
        end = np.where((after > begin) & (c.data[np.maximum(after, 1) - 1] == _NEWLINE), after - 1, after) if len(begin) else after
        has_word = np.searchsorted(c.starts, end) > np.searchsorted(c.starts, begin)
        begin, end, line_doc = begin[has_word], end[has_word], line_doc[has_word]
        n_lines = np.bincount(line_doc, minlength=n)
        distinct = tv.distinct_per_doc(line_doc, c.codes(begin, end)[0], n)
        covered = np.zeros(len(words) + 2, bool)
        if len(words) >= 3:
            at = np.flatnonzero(docs[:-2] == docs[2:])
            size = int(words.max()) + 1
            pair = words[at] * size + words[at + 1]
            pair = pair if size <= 1 << 20 else tv.dense(pair)  # below 2**40 either way
            gram = tv.dense(pair << 20 | words[at + 2] if size <= 1 << 20 else pair * size + words[at + 2])
            key = gram * n + docs[at]
            order = np.argsort(key)
            ranked = key[order]
            same = ranked[1:] == ranked[:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for k in range(3):
                covered[at[twice] + k] = True
        repeat = np.bincount(docs[covered[: len(docs)]], minlength=n) if len(docs) else np.zeros(n, np.int64)
        parts.append([c.n_words, c.count(tv.IS_WORD & _CODE_POINT), c.count(_SYMBOL), n_lines - distinct, repeat, n_lines, c.count(_UPPER), c.count(_LETTER), c.count(_EXCLAIM)])
    joined = [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [[]] * len(MEASURES))]
    return dict(zip(MEASURES, joined))


def bits() -> Column:
    """The failure bits, as an expression over the measures."""
    total = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        total = total.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measures (long) and ``failed`` (long): bit i is set if ``RULES[i]`` failed.

    One narrow pass over the texts, no shuffle.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[m], pa.int64()) for m in MEASURES)], names=[id_col, *MEASURES])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("failed", bits())


def apply_policy(rows: DataFrame, policy: str | int = DEFAULT_POLICY) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(wanted)) == 0)


def ablations(rows: DataFrame, policy: str | int = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents it fails, those only it rejects, and those kept without it.

    The ledger is first summed by its bits (2**len(RULES) rows at most); all else is bit arithmetic on those rows.
    """
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(wanted)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & wanted))
    has, rest = F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("failed").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return (
        by_bits.withColumn("r", F.explode(rules))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(has & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def _failed(got: dict[str, np.ndarray]) -> np.ndarray:
    """The failure bits in numpy, for use inside a pass that holds the texts."""
    total = np.zeros(len(got["n_words"]), np.int64)
    for i, rule in enumerate(RULES):
        parts = [np.ones(len(total), bool)]
        for word, expr in _terms(rule.fails):
            held = eval(expr, {"__builtins__": {}}, got)  # noqa: S307  the expressions are the constants above
            parts[-1] = parts[-1] & held if word == "and" else parts[-1]
            if word == "or":
                parts.append(held)
        total |= np.where(np.logical_or.reduce(parts), 1 << i, 0)
    return total


def _terms(expr: str) -> list[tuple[str, str]]:
    found, word = [], "and"
    for piece in expr.replace(" and ", "\0and\0").replace(" or ", "\0or\0").split("\0"):
        if piece in ("and", "or"):
            word = piece
        else:
            found.append((word, piece))
    return found


def keep_rows(docs: DataFrame, policy: str | int = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no rule of the policy fails."""
    wanted = POLICIES[policy] if isinstance(policy, str) else policy
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array((_failed(measure(b.column(at))) & wanted) == 0))

    return docs.mapInArrow(run, docs.schema)
