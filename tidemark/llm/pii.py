"""Personal data: fixed patterns, and terms that give the found entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Each is
an entity, and so is its group: the e-mail's domain, the address's network (three
parts), the first six digits of a card or phone number.  Then information theory
decides on the words of the texts that hold them: over the whole corpus, a term t
says about an entity e

    PMI(t; e) = log2(P(e | t) / P(e))      of      IC(e) = -log2 P(e)

A term discloses e if it leaves at most ``BITS`` of IC(e) unsaid, that is if
-log2 P(e | t) <= BITS.  P(e | t) is the lower end of a one-sided confidence
interval (Wilson's, at 95 %) for n_te / n_t (rows with t and e, rows with t), so a
term seen once or twice proves nothing however large the corpus is, and nothing
changes with the number of rows.  Copies of a text are one observation: the
interval is for n_t scaled by the share of different texts among the n_te rows.
At full agreement three different texts are the fewest that suffice.  A term that
discloses is generalised, or removed where it never stands without the entity.

A term is a word of any length that touches no pattern's span, wherever it
stands in the text; each of its occurrences in a text that holds the entity is
marked.

The texts are read twice: once for patterns, when texts that have some are kept
aside, once to count the rows of those texts' words only (they are told apart by
a bit set of fixed size).  Pairs that can't reach the threshold whatever their
n_te are left out before pairs are made: n_te is n_e at most, so n_t is bounded.

Edge cases: a null text counts as empty; null ids and repeated rows stay, as
results are joined by text digest.  Extra columns are neither read nor
returned, except by ``sanitised``, which keeps all, whatever their names.  Empty
table: empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Bits of an entity's content that a disclosing term may leave unsaid, and the normal quantile of the interval's one side.
BITS, Z = 1.0, 1.645
#: Bits of the set of terms whose documents are counted: 1 MB whatever the corpus. Full, it costs time, not results.
FILTER_BITS = 23

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
# A match that fails from the start of a run of its first characters fails from within the run as well.
_RUNS = {"email": (re.compile(_EMAIL), re.compile(rf"(?<!{_LOCAL}){_EMAIL}")), "ip": (re.compile(_IP), re.compile(rf"(?<![0-9]){_IP}"))}
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    here, ahead = _RUNS[kind]
    at = 0
    while m := here.match(text, at) or ahead.search(text, at):
        yield m
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, normalised value) by start, then kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end(), m[0].lower()) for m in _matches("email", text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end(), m[0]) for m in _matches("ip", text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end(), d))
        if "+" in text:
            out += [(m.start(), 3, m.end(), d) for m in _PHONE.finditer(text) if 10 <= len(d := _digits(m[0])) <= 15]
    return sorted(out)


def entities(spans: list[tuple[int, int, int, str]]) -> list[str]:
    """The values of spans and the groups that they belong to."""
    out = set()
    for _, k, _, v in spans:
        group = v.rpartition("@")[2] if k == 0 else v.rpartition(".")[0] if k == 1 else v[:6]
        out |= {f"{KINDS[k]}:{v}", f"{KINDS[k]}-group:{group}"}
    return sorted(out)


def _lower(s: str) -> str:
    return s.lower() if s.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def free_words(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the words that touch no span; a word glued to a span is part of its token."""
    out, taken, k = [], sorted((s, e) for s, _, e, _ in spans), 0
    reach = np.maximum.accumulate([e for _, e in taken]).tolist()
    for m in _WORD.finditer(text):
        x, y = m.span()
        while k < len(taken) and reach[k] < x:
            k += 1
        if k == len(taken) or taken[k][0] > y:
            out.append((x, y))
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.int64)
    return np.concatenate([c.word_hash() for _, _, c in tv.each(pa.array(words), lower=False)]).view(np.int64)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:16]


_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = f"digest binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{_SPAN}>, entities array<long>, text string"
_ADDED_TYPE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())])
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass: per row the pattern spans, their digest, the distinct entities, and the text where there are any."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                spans = [base_spans(t) for t in texts]
                values = [entities(x) for x in spans]
                hashes = _hash_words([v for x in values for v in x]).tolist()
                ends = np.cumsum([0, *map(len, values)]).tolist()
                held = [hashes[i:j] for i, j in zip(ends, ends[1:])]
                counts = [pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
                sha = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in x).encode()).hexdigest() for x in spans]
                base = [[{"start": s, "kind": k, "end": e} for s, k, e, _ in x] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([_digest(t) for t in texts], pa.binary()), *counts, pa.array(sha, pa.string()), pa.array(base, pa.list_(_SPAN_TYPE)), pa.array(held, pa.list_(pa.int64())), pa.array([t if x else None for t, x in zip(texts, spans)], pa.string())],
                    names=[id_col, "digest", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "text"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_FOUND}")


def _slots(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (term & mask).astype(np.int64), ((term >> np.uint64(32)) & mask).astype(np.int64)


def _filter(terms: DataFrame) -> np.ndarray:
    """The bit set of ``terms``, built by bitwise aggregation; at most 2**17 words reach the driver."""
    mask = (1 << FILTER_BITS) - 1
    slot = F.explode(F.array(F.col("term").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("term", 32).bitwiseAND(F.lit(mask))))
    words = terms.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    got = words.toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def document_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): rows of ``docs`` that hold each term; others that share its bits may appear too."""
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in batches:
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, c in tv.each(b.column(0), lower=True):
                h = c.word_hash()
                one, two = _slots(h)
                at = np.flatnonzero(bits[one] & bits[two])
                pair = np.stack([h[at], c.doc_of()[at].astype(np.uint64)], axis=1)
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[order]
                fresh = np.ones(len(pair), bool)
                fresh[1:] = (pair[1:] != pair[:-1]).any(axis=1)
                k, n = np.unique(pair[fresh, 0], return_counts=True)
                keys.append(k)
                counts.append(n)
            k, where = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(where, np.concatenate(counts), len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def least_share() -> Column:
    """The lower end for P(e | t), of a row with n_te, n_t (rows) and m_te (different texts among the n_te)."""
    p, n = F.col("n_te") / F.col("n_t"), F.col("n_t") * F.col("m_te") / F.col("n_te")
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


#: Different texts below which an entity can't be disclosed: at full agreement the lower end is m / (m + Z^2).
def fewest_texts(bits: float) -> int:
    share = 2.0**-bits
    return int(np.ceil(Z * Z * share / (1 - share)))


def rare_terms(texts: DataFrame) -> DataFrame:
    """(digest, term): distinct free words of each text, less those that a batch alone shows to stand in over ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, n, most = b.column(0).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy()
            doc, term = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, t in enumerate(b.column(1).to_pylist()):
                words = sorted({_lower(t[x:y]) for x, y in free_words(t, base_spans(t))})
                doc.append(np.full(len(words), i))
                term.append(_hash_words(words))
            doc, term = np.concatenate(doc), np.concatenate(term)
            _, where = np.unique(term, return_inverse=True)
            rows = np.bincount(where, n[doc])[where] if len(doc) else np.zeros(0)
            keep = np.flatnonzero(rows <= most[doc])
            for a in range(0, len(keep), 50_000):
                own = keep[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in doc[own].tolist()], pa.binary()), pa.array(term[own])], names=["digest", "term"])

    return texts.select("digest", "text", "n", "most").mapInArrow(run, "digest binary, term long")


def disclosing(found: DataFrame, docs: DataFrame, bits: float = BITS, text_col: str = "text") -> DataFrame:
    """(digest, term, remove): the terms of each text that disclose an entity of it, and whether one never stands without it."""
    held = found.where(F.size("entities") > 0)
    # copies of a text are summed first
    texts = held.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"))
    of_text = texts.select("digest", "n", F.explode("entities").alias("entity"))
    stats = of_text.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= fewest_texts(bits))
    # n_te / n_t is no less than its interval's lower end, and n_te is n_e at most
    reach = F.col("n_e") * F.lit(2.0**bits)
    groups = written(of_text.join(stats, "entity").groupBy("digest").agg(F.first("n").alias("n"), F.max(reach).alias("most"), F.collect_list(F.struct("entity", "n_e")).alias("shared")), "pii-groups")
    one = held.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))
    terms = written(rare_terms(one.join(groups.select("digest", F.col("n").cast("double").alias("n"), "most"), "digest")), "pii-terms")
    counts = document_counts(docs, terms.select("term").distinct(), text_col)
    rows = written(terms.join(counts, "term").join(groups, "digest").where(F.col("n_t") <= F.col("most")).select("digest", "term", "n", "n_t", "shared"), "pii-pairs")
    shared = rows.select("digest", "term", "n", "n_t", F.explode("shared").alias("x")).select("digest", "term", "n", "n_t", "x.entity", "x.n_e").where(F.col("n_t") <= reach)
    pairs = shared.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("m_te"), F.first("n_t").alias("n_t"))
    pairs = pairs.where(-F.log2(least_share()) <= bits).select("entity", "term", (F.col("n_te") >= F.col("n_t")).alias("remove"))
    every = shared.select("digest", "term", "entity").join(pairs, ["entity", "term"]).groupBy("digest", "term").agg(F.max("remove").alias("remove"))
    out = written(every, "pii-disclosing")
    for t in (groups, terms, rows):
        drop_written(t)
    return out


def all_spans(found: DataFrame, docs: DataFrame, bits: float = BITS, text_col: str = "text") -> DataFrame:
    """(digest, added): per text with disclosing terms, all their spans: start, kind 4, end, and whether to remove or to generalise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                put = {x["term"]: x["remove"] for x in terms}
                words = free_words(t, base_spans(t))
                hashes = _hash_words([_lower(t[x:y]) for x, y in words]).tolist()
                rows.append([{"start": x, "kind": 4, "end": y, "remove": put[h]} for (x, y), h in zip(words, hashes) if h in put])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_ADDED_TYPE))], names=["digest", "added"])

    terms = disclosing(found, docs, bits, text_col).groupBy("digest").agg(F.collect_list(F.struct("term", "remove")).alias("terms"))
    texts = found.where(F.size("entities") > 0).select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))
    return texts.join(terms, "digest").mapInArrow(run, "digest binary, added array<struct<start:int,kind:int,end:int,remove:boolean>>")


def detect(docs: DataFrame, bits: float = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts by kind, base_sha256, ``base`` and ``added`` spans, ``digest`` of the text."""
    found = written(find(docs, id_col, text_col), "pii-found")
    added = all_spans(found, docs, bits, text_col)
    return found.drop("entities", "text").join(added, "digest", "left")


def span_text(base: str = "base", added: str = "added"):
    """Spans as kind:start:end, by start, then kind, comma-joined."""
    plain = F.transform(F.coalesce(F.col(added), F.array()), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    every = F.array_sort(F.concat(F.col(base), plain))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(every, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced; where spans overlap the earlier one wins, what sticks out of it goes too."""
    out, at = [], 0
    for s, e, put in sorted(spans):
        if s >= at:
            out += [text[at:s], put]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, bits: float = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by <KIND>, disclosing terms by <TERM> or nothing; other columns as they were.

    ``n_chars``, if there is such a column of integers, follows the new text.
    """
    found = written(find(docs, id_col, text_col), "pii-found")
    added = all_spans(found, docs, bits, text_col)
    columns, at = docs.columns, docs.columns.index(text_col)
    length = columns.index("n_chars") if "n_chars" in columns else None
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16)
    # the row as one column: no name of its own can clash with those of the join
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), digest.alias("digest"))
    met = whole.join(added, "digest", "left")
    joined = met.select(*(met["row"].getField(c).alias(f"_{i}") for i, c in enumerate(columns)), met["added"].alias("_added"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, more = b.column(at).to_pylist(), b.column(len(columns)).to_pylist()
            new = []
            for t, m in zip(texts, more):
                spans = [(s, e, f"<{KINDS[k].upper()}>") for s, k, e, _ in base_spans(t or "")]
                spans += [(x["start"], x["end"], "" if x["remove"] else "<TERM>") for x in m or []]
                new.append(redact(t, spans) if spans else t)
            out = list(b.columns[: len(columns)])
            out[at] = pa.array(new, out[at].type)
            if length is not None and pa.types.is_integer(out[length].type):
                out[length] = pa.array([len(n) if n is not None else c for n, c in zip(new, out[length].to_pylist())], out[length].type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return joined.mapInArrow(run, docs.schema)
