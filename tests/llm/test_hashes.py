"""Strings on which polynomial hashes modulo a power of two agree, and results that must not rest on hashes."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import minhash_dedup, quality_rules, suffix_dedup, textvec, token_counts
from tidemark.llm.queries import tokenizer_file


def thue_morse(n, a="t", b="h"):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.fixture(scope="module", params=[1024, 2048, 4096])
def pair(request):
    return thue_morse(request.param)


def test_lines_of_equal_polynomials_are_no_duplicates(pair):
    got = quality_rules.measure(pa.array(["\n".join(pair), f"{pair[0]}\n{pair[0]}", " ".join([*pair, "a", *pair, "b"])]))
    assert got["n_dup_lines"].tolist() == [0, 1, 0]
    assert got["n_repeat_words"].tolist() == [0, 0, 0]


def test_token_counts_equal_the_library(pair):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = [" ".join(pair), pair[1], pair[0], None]
    tok = Tokenizer.from_file(path)
    assert token_counts.Counter(path).counts(pa.array(texts)).tolist() == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_shingles_of_different_words_differ(pair):
    a, b = minhash_dedup.shingles(pa.array(list(pair)))
    assert a.tolist() != b.tolist()


def test_removal_of_repeats(spark, pair):
    texts = {1: pair[0], 2: pair[1], 3: "x" + pair[1]}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()} == {i: v[3] for i, v in brute.repeats(texts).items()}


def test_codes_are_exact_even_where_hashes_agree(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(1, 150, 400)] * 2 + list(thue_morse(2048)) * 2
    for hashed in (textvec.Chunk.span_hash, lambda self, s, e: (e - s).astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(textvec.Chunk, "span_hash", hashed)
        ((_, _, c),) = textvec.each(pa.array([" ".join(words)]), lower=False)
        code, at = c.word_codes()
        told = {}
        for k, w in zip(code.tolist(), words):
            assert told.setdefault(k, w) == w
        assert len(told) == len(set(words)) and [words[i] for i in at.tolist()] == [told[k] for k in range(len(at))]


def test_rolling_hash_is_the_same_for_equal_windows():
    ((_, _, c),) = textvec.each(pa.array(["abcdeXabcdeYABCDE"]), lower=True)
    h = c.rolling(5).tolist()
    assert h[0] == h[6] == h[12] and len(set(h)) == len(h) - 2


def test_case_counts_only_where_asked():
    for lower, n in ((True, 1), (False, 2)):
        ((_, _, c),) = textvec.each(pa.array(["Stone stone"]), lower=lower)
        assert len(set(c.word_hash().tolist())) == len(c.word_codes()[1]) == n
