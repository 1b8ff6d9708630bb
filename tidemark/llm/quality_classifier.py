"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled texts are all that the learner sees.  With
class prior pi and a loss l, the unbiased risk is

    pi * E_p[l(f, +)]  +  ( E_u[l(f, -)] - pi * E_p[l(f, -)] )

The second part estimates the risk on negatives and cannot be below zero; where
a step finds it below zero, the step goes against that part's gradient, so the
model cannot gain by it (the non-negative risk).

The features are shares of a text (marks, case, repetition, word shapes, word
variety) and need no vocabulary; the model is a small network with one hidden
layer.  Texts are read once, for a table of features.

Positives for the fit are bounded (``MAX_POSITIVE`` rows, those with the least
hashes of their ids).  Unlabelled texts all count: ``MAX_UNLABELLED`` of them stand
for all, each with the number of rows that are nearest to it as its weight.  The
scaling comes from the moments of all unlabelled rows, the class prior from the
histogram of their scores.

Edge cases: null and empty texts have zero features and get a score like any
other.  Labels without a document, or that are null, are left out; a document
with several labels counts for each.  Null ids are scored and held out from
learning.  Without a positive row, every score is 0.5.  Extra columns are
neither read nor returned.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules as rules
from . import textvec as tv
from .common import written

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
HIDDEN, STEPS, RATE, DECAY = 16, 1500, 0.02, 1e-4
#: Bins of a score's histogram.
BINS = 4096
#: Least distance of the prior from 0 and 1.
PRIOR_EDGE = 0.02
FEATURES = ("symbols", "upper", "exclaims", "dup_lines", "repeat_words", "word_chars", "variety", "log_words", "letters", "line_words", "digits", "bars")
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_BAR = np.arange(256) == 124


def features(column: pa.Array) -> np.ndarray:
    """(n, len(FEATURES)) of each whole text."""
    m = {k: v.astype(np.float64) for k, v in rules.measure(column).items()}
    words, lines, chars = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["word_chars"], 1)
    distinct, digits, bars = [], [], []
    for _, _, c in tv.each(column, lower=True):
        distinct.append(tv.distinct_per_doc(c.doc_of(), c.word_codes()[0], c.n_docs))
        digits.append(c.count(_DIGIT))
        bars.append(c.count(_BAR))
    distinct, digits, bars = (np.concatenate([np.zeros(0), *x]) for x in (distinct, digits, bars))
    # Herdan's C: variety that does not fall with length
    variety = np.where(m["n_words"] > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(m["n_words"], 2)), 1.0)
    return np.stack(
        [
            np.minimum(m["n_symbols"] / words, 3), m["n_upper"] / np.maximum(m["n_letters"], 1), np.minimum(m["n_exclaims"] / words, 3), m["n_dup_lines"] / lines, m["n_repeat_words"] / words,
            np.minimum(m["word_chars"] / words, 30) / 10, variety, np.log1p(m["n_words"]) / 10, m["n_letters"] / chars, np.log1p(m["n_words"] / lines) / 5, digits / chars, np.minimum(bars / words, 2),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, float]
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.hidden[0] + self.hidden[1]) @ self.out[0] + self.out[1] + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled, from histograms (by ascending score) of rows that the scorer wasn't fitted on.

    Best bin: above any threshold the unlabelled share is at least prior times the positive share, and almost equal
    where hardly a negative scores that high.  Of all thresholds the one with the least upper bound is taken.
    """
    u, p = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (unlabelled, positive))
    slack = sum(np.sqrt(np.log(4 / confidence) / (2 * x.sum())) for x in (positive, unlabelled))
    used = p > 0
    ratio, bound = u[used] / p[used], (u[used] + slack) / p[used]
    return float(np.clip(ratio[np.argmin(bound)], PRIOR_EDGE, 1 - PRIOR_EDGE))


def histogram(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _forward(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, h @ w[2] + w[3][0]


def risks(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * E_p[l(f, +)], E_u[l(f, -)] - prior * E_p[l(f, -)]) with the logistic loss; ``weight`` sums to 1."""
    zp, zu = _forward(w, p)[1], _forward(w, u)[1]
    return prior * np.logaddexp(0, -zp).mean(), float(weight @ np.logaddexp(0, zu)) - prior * np.logaddexp(0, zp).mean()


def step_of(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, weight: np.ndarray, prior: float) -> list[np.ndarray]:
    """The direction to go against: the whole risk's gradient, or, where the part on negatives is below zero, that part's gradient turned round."""

    def back(x, h, dz):
        dh = np.outer(dz, w[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]

    (hp, zp), (hu, zu) = _forward(w, p), _forward(w, u)
    # calling x negative costs softplus(z), whose slope is sigmoid(z)
    on_negatives = weight @ np.logaddexp(0, zu) - prior * np.logaddexp(0, zp).mean()
    as_negative = [a - b for a, b in zip(back(u, hu, _sigmoid(zu) * weight), back(p, hp, prior * _sigmoid(zp) / len(p)))]
    if on_negatives < 0:
        return [-b for b in as_negative]
    return [a + b for a, b in zip(back(p, hp, prior * (_sigmoid(zp) - 1) / len(p)), as_negative)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weight: np.ndarray | None = None, moments: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 5, steps: int = STEPS) -> Model:
    """Minimises the non-negative risk with the logistic loss, by Adam over all rows given."""
    mean, scale = moments if moments is not None else (unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3)
    weight = np.full(len(unlabelled), 1 / len(unlabelled)) if weight is None else weight / weight.sum()
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((p.shape[1], HIDDEN)) / np.sqrt(p.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        for k, g in enumerate(step_of(w, p, u, weight, prior)):
            g = g + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, (w[0], w[1]), (w[2], float(w[3][0])))


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row, written once: all later passes read it instead of the texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1))
            off = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], names=["doc_id", "x"])

    return written(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, x array<double>"), "quality-features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def _collected(rows: DataFrame) -> np.ndarray:
    x = np.array(rows.select("x").toPandas()["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return x[np.lexsort(x.T)]  # the order of rows that arrive from tasks must not matter


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of arrays that ``of`` makes of a batch: tasks add up, then their few rows are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                got = of(_matrix(b.column(0).slice(a, 1000)))
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.float64))], names=["k", "v"])

    got = rows.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(got["k"].max()) + 1 if len(got) else 0)
    out[got["k"].to_numpy(np.int64)] = got["v"].to_numpy()
    return out


def nearest_counts(rows: DataFrame, points: np.ndarray, moments: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of ``points`` the number of rows that are nearest to it, by scaled features (of equally near ones to the first)."""
    mean, scale = moments
    near = np.clip((points - mean) / scale, -6, 6).astype(np.float32)
    half = (near * near).sum(axis=1) / 2

    def of(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6).astype(np.float32)
        return np.bincount(np.argmin(half - z @ near.T, axis=1), minlength=len(near))

    out = _summed(rows, of)
    return np.append(out, np.zeros(len(points) - len(out)))


def train_on(table: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", label_col: str = "quality") -> tuple[Model | None, float]:
    """The model (None without positives) and the prior, of a ``feature_table``. Only rows that aren't held out take part."""
    rows = table.where(~held_out(F.col("doc_id")))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    drawn = (_sample(known.where("label = 1").select("doc_id").distinct(), max_positive, 1), _sample(rows.select("doc_id").distinct(), max_unlabelled, 2))
    positive, points = (_collected(rows.join(F.broadcast(ids), "doc_id")) for ids in drawn)  # ids of a stated number
    if not len(positive) or not len(points):
        return None, 0.5
    k = len(FEATURES)
    sums = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    sums = np.append(sums, np.zeros(2 * k + 1 - len(sums)))
    mean = sums[1 : k + 1] / sums[0]
    moments = mean, np.sqrt(np.maximum(sums[k + 1 :] / sums[0] - mean * mean, 0)) + 1e-3
    weight = nearest_counts(rows, points, moments)
    prior = 0.5
    if min(len(positive), len(points)) >= 20:
        # points are in the order of their features: every other one is a fair half; the scorer's own count little among all rows
        first = fit(positive[::2], points[::2], 0.5, weight[::2] + 1e-9, moments)
        seen = _summed(rows, lambda x: histogram(first.score(x)))
        seen = np.append(seen, np.zeros(BINS - len(seen))) - histogram(first.score(points[::2]))
        prior = class_prior(histogram(first.score(positive[1::2])), np.maximum(seen, 0))
    return fit(positive, points, prior, weight, moments), prior


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Model | None, float]:
    return train_on(feature_table(docs, id_col, text_col), labels, max_positive, max_unlabelled, id_col, label_col)


def score_on(table: DataFrame, model: Model | None, prior: float, id_col: str = "doc_id") -> DataFrame:
    """Per row of a ``feature_table``: id, score (0 to 1, higher: better)."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(_matrix(b.column(1))) if model is not None else np.full(b.num_rows, prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    return table.mapInArrow(run, f"`{id_col}` {kind}, score double")


def score(docs: DataFrame, model: Model | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1, higher: better)."""
    return score_on(feature_table(docs, id_col, text_col), model, prior, id_col)
