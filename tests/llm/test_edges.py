"""Ids of any type, very long texts, clashing names, and the pipeline on odd tables."""

import re
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, minhash_dedup, mixing, pii, quality_classifier, quality_rules, sentencepiece, suffix_dedup, token_counts
from tidemark.llm.queries import tokenizer_file

WORDS = "the of stone river cloud maple copper violet winter signal harbour meadow lantern quiet bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def test_text_ids_in_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = prose(rng, 60)
    texts = {"d": base, "c": base.replace("stone", "stone", 1) + " end", "b": prose(rng, 70), "10": base, "9": "", "é": base + " end"}
    df = spark.createDataFrame([*texts.items(), (None, base)], "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, percent=80).collect()}
    want = brute.near_duplicates(texts, 80)
    assert {i: got[i] for i in texts} == want and got[None][1] is None and got[None][2]


def test_text_ids_in_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 16))
    rows = [("b", v[0]), ("a", v[0] + 0.01 * v[1]), ("c", v[2]), ("aa", v[0] * 3), ("z", None)]
    df = spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in rows], "vec_id string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {"a": (2, "a", True), "aa": (2, "a", False), "b": (2, "a", False), "c": (0, "c", True), "z": (0, "z", True)}


@pytest.fixture(scope="module")
def long_texts():
    """Two texts of over a megabyte that share most, and a short one."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(4000)]
    base = list(rng.choice(words, 200_000))
    other = list(base)
    for k in rng.integers(0, len(base), 40):
        other[k] = "changed"
    return {1: " ".join(base), 2: " ".join(other) + "\n" + " ".join(base[:50]), 3: "short"}


def test_long_texts(spark, long_texts):
    texts = long_texts
    assert min(len(texts[1]), len(texts[2])) > 1 << 20
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    n = {r.doc_id: r for r in quality_rules.ledger(df).collect()}
    for i, t in texts.items():
        w = t.split()
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert (n[i].n_words, n[i].word_chars, n[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    model = quality_classifier.fit(np.random.default_rng(0).normal(size=(30, 12)), np.random.default_rng(1).normal(size=(40, 12)), 0.5, steps=5)
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(df, model, 0.5).collect())
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, percent=85).collect()}
    assert got == brute.near_duplicates(texts, 85) and got[2][1] == 1
    kept = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert kept == brute.repeats(texts) and kept[2][1] > 1_000_000


def test_clashing_names_in_the_mix(spark):
    rows = [(i, "one two three", "s", f"k{i}", "b") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string, mix_row string")
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == set(rows) and got.count() == 12


def test_contents_are_normalised_as_the_tokenizer_does(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["The  Stone\tRIVER", "the stone river", "THE STONE\n\n river", "<|EndOfText|> a", "<|endoftext|> a", "<|ENDOFTEXT|>  A", "É́ Å Å", "K ß İ ǅ", " x ", "x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = f"file://{tmp_path}/s"
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, path, store).collect()}
    assert got == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert spark.read.parquet(store).count() <= len(texts) - 3  # three ways to write one content, one empty text twice
    token_counts.count_tokens(df, path, store)
    assert spark.read.parquet(store).count() == spark.read.parquet(store).select("digest").distinct().count()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(21)
    clean = lambda k: prose(np.random.default_rng(k), 80)
    rows = [(k, clean(k), "en", f"s{k % 2}", 1) for k in range(20)]
    rows += [(3, clean(3), "en", "s1", 1), (None, clean(3), "en", "s0", 1), (None, clean(90), "de", None, 1), (None, clean(90) + " end", "de", "s0", 1), (7, clean(91), None, "s1", 1), (7, clean(92), None, "s1", 1)]
    rows += [(40, clean(93) + " write to zaph@mail.example.com", "en", "s0", 1), (41, "too short", "en", "s0", 1), (42, None, "en", "s0", 1), (43, "", "en", "s0", 1), (44, f"{prose(rng, 30)} " * 6, "en", "s1", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("extra", F.lit("x")).repartition(3)


def plain_stages(rows):
    """What the first four stages keep: rules, one row of each group, patterns replaced."""
    got = [r for r in rows if not any(int(v[0]) for v in [_failed(r[1])])]
    yield got
    order = sorted(range(len(got)), key=lambda k: (got[k][0] is None, got[k][0] or 0, got[k][1].encode()))
    kept = {k for k, v in brute.near_duplicates({n: got[k][1] for n, k in enumerate(order)}, 80).items() if v[2]}
    got = [got[k] for n, k in enumerate(order) if n in kept]
    yield got
    out = []
    for i, t, lang, s, _ in got:
        new = pii.redact(t, [(a, e, f"<{pii.KINDS[k].upper()}>") for a, k, e, _ in pii.base_spans(t)])
        out.append((i, new, lang, s, len(new) if new != t else _))
    yield out


def _failed(text):
    m = quality_rules.measure(pa.array([text]))
    n = {k: int(v[0]) for k, v in m.items()}
    rules = [
        n["n_words"] < 50, 100 * n["n_repeat_words"] > 50 * n["n_words"], 100 * n["n_symbols"] > 20 * n["n_words"], 100 * n["n_upper"] > 50 * n["n_letters"] and n["n_letters"] > 0,
        100 * n["n_exclaims"] > 20 * n["n_words"], 100 * n["n_dup_lines"] > 50 * n["n_lines"], n["word_chars"] < 2 * n["n_words"] or n["word_chars"] > 20 * n["n_words"],
    ]
    return [any(rules)]


def order(rows):
    return sorted(rows, key=repr)


def test_pipeline_stages_equal_plain_versions(spark, corpus, tmp_path):
    rows, docs = corpus
    want = list(plain_stages(rows))
    for (name, stage), plain in zip(corpus_pipeline.STAGES, want):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert order((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()) == order(p[:4] for p in plain)
    assert len(want[0]) < len(rows) and len(want[1]) < len(want[0])
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert all(taken[s] <= 2 * size[s] + 80 for s in size) and set(taken) == set(size)
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, "")
    codec = sentencepiece.Codec.load(tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null and doc_id <> 7").collect()}
    for r in ids.where("doc_id is not null and doc_id <> 7").collect():
        assert re.sub(r"\s+", " ", codec.decode(list(r.ids))).strip() == re.sub(r"\s+", " ", texts[r.doc_id]).strip()


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    corpus[1].select(*corpus_pipeline.COLUMNS).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
