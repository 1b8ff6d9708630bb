import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, context_mixing, embedding_dedup, minhash_dedup, mixing, pii, quality_classifier, quality_rules, sentencepiece, suffix_dedup, textvec, token_counts
from tidemark.llm.queries import tokenizer_file

WORDS = "the and attion thanedble anea eriner of in stone river cloud maple copper violet winter signal harbour meadow lantern quiet bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    out = {i: prose(rng, int(rng.integers(1, 220))) for i in range(60)}
    base = prose(rng, 150).split()
    for k in range(8):  # near copies of one text
        w = list(base)
        for j in rng.integers(0, 150, k):
            w[j] = "changed"
        out[100 + k] = " ".join(w)
    out |= {200: out[3], 201: out[3], 202: None, 203: "", 204: " \n\t ", 205: "one", 206: "ONE", 207: "a b c d", 208: out[5] + "\n" + out[5], 209: "ab " * 400, 210: "x" * 3000, 211: "é日本 🙂 " * 40, 212: "ab " * 300}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With null ids, repeated rows and an extra column of a clashing name."""
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_are_runs_of_non_space_bytes(texts):
    column = pa.array(list(texts.values()))
    for _, _, c in textvec.each(column, lower=False):
        data = c.data.tobytes()
        assert [data[s:e].decode() for s, e in zip(c.starts, c.ends)] == [w for t in texts.values() for w in brute.WORD.findall(t or "")]
        assert len(set(c.word_hash().tolist())) == len({data[s:e] for s, e in zip(c.starts, c.ends)})


def test_quality_rules(docs, texts, empty):
    got = rows_of(quality_rules.apply_policy(quality_rules.ledger(docs)))
    for i, t in texts.items():
        t = t or ""
        w = brute.WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][m] for m in quality_rules.MEASURES[:5]) == want, i
    assert quality_rules.ledger(empty).count() == 0
    kept = {r.doc_id for r in quality_rules.keep_rows(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    by_rule = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    few = sum(1 for r in got.values() if r.failed & 1)
    only = sum(1 for r in got.values() if r.failed == 1)
    assert (by_rule["few_words"].n_failed, by_rule["few_words"].n_only) == (few, only)
    assert by_rule["few_words"].n_kept_without == only + len(kept)


def test_classifier_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (600, 3)), rng.normal(0, 1, (600, 3)) + [4, 0, 0]
    unlabelled = np.vstack([good[:350], bad[:150]])
    first = quality_classifier.fit(good[350:475], unlabelled[::2], 0.5)
    prior = quality_classifier.class_prior(*(quality_classifier.histogram(first.score(x)) for x in (good[475:], unlabelled[1::2])))
    assert prior == pytest.approx(0.7, abs=0.1)
    model = quality_classifier.fit(good[350:], unlabelled, prior)
    accuracy = np.concatenate([model.score(good) >= 0.5, model.score(bad[150:]) < 0.5]).mean()
    assert accuracy > 0.95


def test_non_negative_step_equals_differences_of_the_risk():
    """The step is the risk's gradient by differences, or that of the part on negatives, turned, where that part is below zero."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(0, 1, (40, 3)), rng.normal(0.3, 1, (60, 3))
    weight = rng.uniform(0, 1, 60)
    weight /= weight.sum()
    seen = set()
    for prior, size in ((0.3, 0.5), (0.95, 0.5), (0.95, 3.0), (0.6, 2.0)):
        w = [rng.normal(0, size, s) for s in ((3, 4), (4,), (4,), (1,))]
        risk, below = quality_classifier.risks(w, p, u, weight, prior), quality_classifier.risks(w, p, u, weight, prior)[1] < 0
        plain = sum(float(a) * quality_classifier.risks(w, p, u[i : i + 1], np.ones(1), 0.0)[1] for i, a in enumerate(weight))
        assert risk[1] == pytest.approx(plain - prior * np.mean([np.log1p(np.exp(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0])) for x in p]))
        seen.add(below)
        value = (lambda: -quality_classifier.risks(w, p, u, weight, prior)[1]) if below else (lambda: sum(quality_classifier.risks(w, p, u, weight, prior)))
        for g, m in zip(quality_classifier.step_of(w, p, u, weight, prior), w):
            for at in np.ndindex(m.shape):
                m[at] += 1e-6
                up = value()
                m[at] -= 2e-6
                assert g[at] == pytest.approx((up - value()) / 2e-6, abs=1e-5)
                m[at] += 1e-6
    assert seen == {True, False}


def test_every_unlabelled_row_counts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, len(quality_classifier.FEATURES)))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)
    moments = x.mean(axis=0), x.std(axis=0)
    points = x[:20]
    scaled = np.clip((x - moments[0]) / moments[1], -6, 6)
    want = Counter(int(np.argmin(((scaled[:20] - z) ** 2).sum(axis=1))) for z in scaled)
    assert quality_classifier.nearest_counts(df, points, moments).tolist() == [want[k] for k in range(20)]


def test_classifier_on_held_out_labels(spark):
    from tidemark.llm.queries import op2_quality_classifier

    sf = "/root/testdata/sf0.01"
    got = op2_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in got)
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in got]) > 0.93


def test_classifier_without_rows(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model, prior = quality_classifier.train(empty, labels)
    assert model is None and {r.score for r in quality_classifier.score(docs, model, prior).collect()} == {0.5}


def _codec():
    return sentencepiece.Codec.load(tokenizer_file("piece_bpe_32k.model"))


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    pieces = [(t, float(s), i + 300) for i, (t, s) in enumerate({"a": -3, "b": -4, "ab": -4.5, "ba": -5, "abb": -6, "▁": -1, "▁a": -2.5, "bab": -4, "aa": -7}.items())]
    codec = sentencepiece.Codec(pieces, None, 0, 400)
    codec.by_word = False
    cost = {t: s for t, s, _ in pieces}
    name = {i: t for t, _, i in pieces} | {0: "?"}

    def best(s, at=0, memo={}):  # noqa: B006
        if at == len(s):
            return 0.0
        if (s, at) not in memo:
            options = [cost[s[at:e]] + best(s, e) for e in range(at + 1, len(s) + 1) if s[at:e] in cost]
            if s[at] not in cost:
                options.append(codec.unknown_score + best(s, at + 1))
            memo[s, at] = max(options)
        return memo[s, at]

    for _ in range(300):
        s = "▁" + "".join(rng.choice(list("ab▁x"), int(rng.integers(0, 9))))
        ids = codec.best(s)
        assert sum(cost.get(name[i], codec.unknown_score) for i in ids) == pytest.approx(best(s))


def test_encoding_round_trip_and_library(docs, texts, empty):
    codec = _codec()
    got = rows_of(sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model"), verify=True))
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.values()) and len(got) == len(texts)
    assert got[202].ids == [] and sentencepiece.encode(empty, tokenizer_file("piece_bpe_32k.model")).count() == 0
    back = rows_of(sentencepiece.decode(sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model")), tokenizer_file("piece_bpe_32k.model")))
    assert all(back[i].text == (t or "") for i, t in texts.items())
    # the library reads the same pieces as a unigram model when told so: its lattice search is an independent Viterbi
    import sentencepiece as library

    raw = bytearray(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    raw[raw.rindex(b"\x06tok_v0\x18\x02") + 8] = 1
    unigram = library.SentencePieceProcessor(model_proto=bytes(raw))
    cost = lambda ids: sum(unigram.get_score(i) if not unigram.is_byte(i) else 0 for i in ids)
    for t in ["the", "an anea of the river", "naive cafe", "Signal harbour meadow"]:
        assert cost(codec.encode(t).tolist()) == cost(unigram.nbest_encode(t, nbest_size=4)[0])


def test_token_counts(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = {300: "it's <|endoftext|>x <|ENDOFTEXT|>", 301: "É ÉX  \x0b q\x85w 12ab İ ΑΣ", 302: "don't!! ##'s 's|"}
    every = texts | extra
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    store = f"file://{tmp_path}/store"
    got = rows_of(token_counts.count_tokens(df, path, store))
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in every.items()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    n = spark.read.parquet(store).count()
    # contents are kept as the tokenizer normalises them, those that spell a special token as they are
    assert n == len({t if "<|" in (t or "") else re.sub(r"[\x20\x09-\x0D]+", " ", brute.lower(t or "")) for t in every.values()})
    more = df.union(spark.createDataFrame([(900, "brand new words"), (901, "brand new words")], "doc_id long, text string"))
    assert len(token_counts.count_tokens(more, path, store).collect()) == len(every) + 2
    assert spark.read.parquet(store).count() == n + 1
    assert token_counts.count_tokens(empty, path).count() == 0
    sp = rows_of(token_counts.count_tokens(docs.where("doc_id < 5"), tokenizer_file("piece_bpe_32k.model")))
    assert all(r.n_tokens > 0 for r in sp.values())


def test_mixing(docs, texts, empty):
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect()
    assert sorted((r.doc_id, r.mix_times) for r in rows) == sorted((r.doc_id, r.mix_times) for r in again)
    size = {i: len(brute.WORD.findall(t or "")) for i, t in texts.items()}
    assert all(r.mix_size == size[r.doc_id] and r.mix_times <= 2 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].mix_source_size == sum(r.mix_size for r in own)
        taken = sum(r.mix_size * r.mix_times for r in own)
        assert abs(taken - own[0].mix_target) <= max(r.mix_size for r in own)
    # the targets come to what repeated resharing gives
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, full = dict(zip(names, (5, 2, 1, 5))), {s: 2 * by[s][0].mix_source_size for s in names}
    target, open_, rest = {}, set(names), 1.5 * sum(size.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[k] for k in open_) for s in open_}
        over = {s for s in open_ if share[s] > full[s]}
        for s in over or open_:
            target[s] = full[s] if over else share[s]
            rest -= target[s]
        open_ -= over or set(open_)
    assert all(by[s][0].mix_target == pytest.approx(target[s]) for s in names)
    assert mixing.mixed_rows(docs).count() == sum(r.mix_times for r in rows)
    assert mixing.mix(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("hot, held", [(1024, 1 << 20), (1, 1 << 20), (1, 300), (1024, 300)])
def test_repeats(spark, texts, hot, held):
    shared = "one hot passage that stands in every third document, long enough to be a window of its own for sure, and then some "
    rows = [*texts.items(), (None, texts[4]), (3, texts[6] + " tail"), (9, texts[9]), *((1000 + k, f"{k} {shared} {k * 7919 % 97}") for k in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) for r in suffix_dedup.remove_repeats(df, hot_contents=hot, held_bytes=held).collect()]
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    plain = brute.repeats({k: t for k, (_, t) in enumerate(distinct)})
    want = {d: plain[k] for k, d in enumerate(distinct)}
    expected = [(i, *want[i, t or ""], hashlib.sha256(want[i, t or ""][3]).hexdigest()) for i, t in rows]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_refinement_groups_equal_windows():
    rng = np.random.default_rng(2)
    rows = [bytes(rng.choice([97, 98], int(rng.integers(100, 180))).astype(np.uint8)) for _ in range(6)] + [b"ab" * 80, b"ba" * 70]
    data, off = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at, bucket = suffix_dedup.refine(np.zeros(len(rows), np.int64), data, off)
    by = {}
    for a, b in zip(at.tolist(), bucket.tolist()):
        by.setdefault(b, set()).add(data[a : a + 100].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({w for r in rows for i in range(len(r) - 99) for w in [r[i : i + 100]]})


def test_context_mixing(docs, texts, empty):
    got = rows_of(context_mixing.scores(docs))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: brute.WORD.findall(brute.lower(t or "")) + [None] for i, t in texts.items()}
    count = Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]))
        assert r.score < 0
    assert got[205].score == got[206].score  # case doesn't count
    assert context_mixing.scores(empty).count() == 0


def _coded(texts):
    return context_mixing.tokens_of(*textvec.flat(pa.array(texts)))


def test_coded_tokens():
    data, off = _coded(["  Ab\tc\n\nÄd ", "", "x", " \n"])
    assert [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == ["ab c Äd \n", "\n", "x \n", "\n"]


BITS = (20, 22, 22)


def _model(texts, learns):
    """Tree and tables as the operator makes them, without Spark."""
    data, off = _coded(texts)
    before = np.concatenate([[10], data[:-1]]).astype(np.int64)
    before[off[:-1]] = 10
    tree = context_mixing.Tree.of(np.bincount(before * 256 + data, minlength=1 << 16).reshape(256, 256))
    counts = [np.zeros(2 << b, np.uint32) for b in BITS]
    context_mixing.count_bits(*_coded([t for t, k in zip(texts, learns) if k == 1]), tree, BITS, counts)
    return data, off, tree, [context_mixing.states(t[0::2].astype(np.int64), t[1::2].astype(np.int64)) for t in counts]


def test_costs_equal_a_plain_model(texts):
    """Contexts in dicts, one decision after the other, weights moved every STEP bytes and carried to the end."""
    rng = np.random.default_rng(3)
    own = [t or "" for t in texts.values()][:25] + ["ab " * 700 + "abc", "x" * 90 + " y"]
    learns = rng.integers(0, 2, len(own)).astype(np.int8)
    data, off, tree, tables = _model(own, learns)
    start = rng.uniform(0.1, 0.6, (context_mixing.GATES, 3)).astype(np.float32)
    got = context_mixing.cost(data, off, tree, BITS, tables, start)
    deep = tree.place.shape[1]

    def decisions(text):
        padded = b"\n" * 16 + text
        for at in range(16, len(padded)):
            past, symbol = padded[:at], padded[at - 1] * 256 + padded[at]
            word = re.split(b"[ \n]", past[-16:])[-1]
            for k in range(tree.length[symbol]):
                node = int(tree.place.ravel()[symbol * deep + k])
                yield at - 16, int(tree.bit.ravel()[symbol * deep + k]), [("3", past[-3:], node), ("5", past[-5:], node), ("w", word, node)]

    pieces = [data[a:b].tobytes() for a, b in zip(off, off[1:])]
    seen = Counter((key, bit) for text, learnt in zip(pieces, learns) if learnt == 1 for _, bit, keys in decisions(text) for key in keys)

    def plain(text):
        w, scale, shift, bits, step, pending = start.astype(float), 1.0, 0.0, 0.0, 0, []

        def move():
            nonlocal scale, shift
            for gate, g, _, _ in pending:
                w[gate] += context_mixing.RATE * g
            scale = min(max(scale + context_mixing.RATE_LAST / 4 * sum(x[2] for x in pending), 0.5), 2)
            shift = min(max(shift + context_mixing.RATE_LAST * sum(x[3] for x in pending), -1), 1)
            pending.clear()

        for at, bit, keys in decisions(text):
            if at // context_mixing.STEP != step:
                move()
                step = at // context_mixing.STEP
            n = [(seen[k, 0], seen[k, 1]) for k in keys]
            x = np.array([min(max(round(math.log((b + 0.35) / (a + 0.35)) * 4), -31), 31) / 4 for a, b in n])
            level = [sum(sum(c) >= m for m in (1, 4, 31)) for c in n]
            gate = level[2] * 4 + level[1]
            z = min(max(float(w[gate] @ x), -12), 12)
            p, q = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-(scale * z + shift)))
            bits -= math.log2(q if bit else 1 - q)
            pending.append((gate, (bit - p) * x, (bit - q) * z, bit - q))
        return bits

    # two contexts that share a slot of the hashed tables may move a cost a little
    assert np.allclose(got, [plain(t) for t in pieces], rtol=2e-3)


def test_decisions_of_equal_contexts_are_counted_together(texts, monkeypatch):
    """The tables are those of one decision after the other, across blocks too; what repeats is looked up once."""
    found, slots = [], context_mixing._slots
    monkeypatch.setattr(context_mixing, "_slots", lambda c, k, b, which, place: found.append(len(which)) or slots(c, k, b, which, place))
    data, off = _coded([t or "" for t in texts.values()] + ["", "a", "\n", "ab", "the same words again " * 3000])
    tree = context_mixing.Tree.of(np.ones((256, 256), np.int64))
    plain = [np.zeros(2 << b, np.uint32) for b in BITS]
    for group in context_mixing.sides(off, np.arange(len(off) - 1)):
        for s in context_mixing.segments(data, off, group, tree, BITS):
            for table, slot in zip(plain, s.slots):
                np.add.at(table, 2 * slot + s.bit, np.uint32(1))
    every = sum(found)
    for chunk, block in ((1 << 20, 1 << 16), (1 << 12, 1 << 8), (1001, 7)):
        found.clear()
        monkeypatch.setattr(context_mixing, "CHUNK", chunk)
        monkeypatch.setattr(context_mixing, "SEGMENT_BYTES", block)
        counts = [np.zeros(2 << b, np.uint32) for b in BITS]
        context_mixing.count_bits(data, off, tree, BITS, counts)
        assert all(np.array_equal(a, b) for a, b in zip(counts, plain))
        assert chunk < 1 << 20 or sum(found) < every / 2


def test_decisions_of_a_context_are_neighbours():
    """Nearly all decisions of a byte read one line of 64 slots; ascending hashes have ascending slots but for the 15 bits of a place."""
    data, off, tree, _ = _model(["the stone river of the quiet cloud and " * 40], np.ones(1, np.int8))
    before = np.concatenate([[10], data[:-1]]).astype(int)
    first = np.cumsum(tree.length[before * 256 + data])
    within = np.setdiff1d(np.arange(1, first[-1]), first)
    (whole,) = context_mixing.segments(data, off, np.array([0]), tree, BITS)
    assert len(whole.bit) == first[-1] and len(within) > 500
    for slot in whole.slots:
        assert np.mean(slot[within] >> 6 == slot[within - 1] >> 6) > 0.95
    for k, bits in ((1, 22), (2, 24)):
        hashes = np.sort(np.random.default_rng(k).integers(0, 1 << 32, 1000, dtype=np.uint32))
        slot = context_mixing._slots(hashes, k, bits, np.arange(1000), np.full(1000, tree.place.max()).astype(np.intp))
        assert (np.diff(slot >> 15) >= 0).all() and slot.max() < 1 << bits


def test_coded_tokens_equal_a_plain_loop():
    rng = np.random.default_rng(7)
    own = ["".join(rng.choice(list("aB \n\tä"), int(rng.integers(0, 8)))) for _ in range(400)]
    data, off = _coded(own)
    want = ["".join(w + " " for w in brute.WORD.findall(brute.lower(t))) + "\n" for t in own]
    assert [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == want


def test_logs_of_large_products():
    t = np.array([2, 3, 1e30, 1e30] + [7e10] * 40, np.float32)
    assert np.allclose(context_mixing._logs(t, np.array([0, 2, 4])), [math.log(6), 60 * math.log(10), 40 * math.log(7e10)])


def test_every_code_is_complete(texts):
    tree = _model([t or "" for t in texts.values()], np.ones(len(texts), np.int8))[2]
    assert np.allclose((0.5 ** tree.length.reshape(256, 256)).sum(axis=1), 1)


def test_cost_does_not_depend_on_neighbours(texts, monkeypatch):
    own = [t or "" for t in texts.values()] + ["a long text of many words " * 9000]
    data, off, tree, tables = _model(own, np.ones(len(own), np.int8))
    start = np.tile(context_mixing.START, (context_mixing.GATES, 1))
    together = context_mixing.cost(data, off, tree, BITS, tables, start)
    monkeypatch.setattr(context_mixing, "SEGMENT_BYTES", 1 << 12)
    alone = [context_mixing.cost(data[a:b], np.array([0, b - a]), tree, BITS, tables, start)[0] for a, b in zip(off[:-1], off[1:])]
    assert np.allclose(together, alone, rtol=1e-4)


def test_scores_do_not_depend_on_the_layout(spark, docs):
    one, many = (sorted(context_mixing.scores(docs.repartition(n)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.score)) for n in (1, 5))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert np.allclose([r[5:8] for r in one], [r[5:8] for r in many], rtol=1e-4)


def test_newton_sums():
    """The pull is the slope of the loss, by differences."""
    rng = np.random.default_rng(4)
    state, bit, n = rng.integers(0, 256, (3, 500)).astype(np.uint8), rng.integers(0, 2, 500).astype(float), rng.integers(1, 5, 500).astype(float)
    w = np.tile(context_mixing.START.astype(float), (context_mixing.GATES, 1))
    x, gate = context_mixing._mixed(state)

    def loss(w):
        z = (w[gate].T * x).sum(axis=0)
        return np.bincount(gate, n * np.log1p(np.exp(np.where(bit == 1, -z, z))), context_mixing.GATES)

    got = context_mixing.newton_sums(state, bit, n, w)
    for i in range(3):
        up, down = w.copy(), w.copy()
        up[:, i] += 1e-4
        down[:, i] -= 1e-4
        assert np.allclose(got[:, 9 + i], -(loss(up) - loss(down)) / 2e-4, rtol=1e-3, atol=1e-3)


def test_tables_hold_the_counts_of_a_plain_loop(spark, texts):
    own = [t or "" for t in texts.values()]
    tree = context_mixing.Tree.of(np.ones((256, 256), np.int64))
    counts = [np.zeros(2 << b, np.uint32) for b in BITS]
    context_mixing.count_bits(*_coded(own), tree, BITS, counts)
    docs = spark.createDataFrame([(t, 1) for t in own] + [("never learnt", 0), ("kept for weights", 2)], "text string, learns int").repartition(3)
    for got, want in zip(context_mixing.learn(docs, tree, BITS), counts):
        assert np.array_equal(got, context_mixing.states(want[0::2].astype(np.int64), want[1::2].astype(np.int64)))
    few, many = context_mixing.slots_for(10**6), context_mixing.slots_for(10**10)
    assert few == context_mixing.LEAST_SLOTS and many == context_mixing.MOST_SLOTS


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [1.0, -1.0]), (5, [5e-324, 5e-324]), (6, [1e200, -1e-200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def _vectors(rng):
    base = rng.standard_normal((150, 16))
    near = base[:20] + 0.15 * rng.standard_normal((20, 16))
    hub = base[:1] + 0.05 * rng.standard_normal((60, 16))
    return np.vstack([base, near, hub, base[3:4], base[3:4], base[4:5] * 7])


def test_vector_near_duplicates(spark):
    rng = np.random.default_rng(5)
    x = _vectors(rng)
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate([*x.tolist(), *odd])] + [(None, x[3].tolist())]
    got = rows_of(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-4), "vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = brute.components(range(len(x)), list(zip(*(k.tolist() for k in np.nonzero(linked)))))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum() + (u[i] @ u[3] >= 0.9), comp[i], comp[i] == i), i
    assert all((got[len(x) + k].n_links, got[len(x) + k].component_id) == (0, len(x) + k) for k in range(len(odd)))
    assert got[None].component_id is None and got[None].kept
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_patterns():
    import random

    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out)

    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@-_+% 0(5") for _ in range(rng.randint(0, 40)))
        assert [x[:3] for x in pii.base_spans(t)] == plain(t), t
    pii.base_spans("a" * 200_000 + "1" * 200_000)  # long runs take linear time
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_disclosing_terms(spark, empty):
    rng = np.random.default_rng(9)
    rows = [(i, f"{prose(rng, 30)} Zaphodia wrote from zaph@mail.example.com about the river {prose(rng, 20)}", i) for i in range(6)]
    rows += [(100 + i, prose(rng, 60), i) for i in range(80)] + [(200, None, 1), (201, "", 1), (None, "call +1 (555) 555-0199 now", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = rows_of(pii.detect(df).withColumn("spans", pii.span_text()))
    text = dict((r[0], r[1]) for r in rows)
    for i in range(6):
        terms = [text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert "Zaphodia" in terms and "the" not in terms and got[i].n_email == 1
    assert all("term" not in got[100 + i].spans for i in range(80)) and got[200].spans == ""
    clean = rows_of(pii.sanitised(df))
    assert "Zaphodia" not in clean[0].text and "<EMAIL>" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[105].text == text[105] and clean[200].text is None and clean[None].text == "call <PHONE> now"
    assert pii.detect(empty).count() == 0 and pii.sanitised(empty).count() == 0
    assert pii.redact("abcdef", [(1, 3, "X"), (2, 4, "Y")]) == "aXef"


@pytest.mark.parametrize("n", [1000, 2000, 4000])
def test_a_term_of_one_text_proves_nothing_at_any_size(spark, n):
    """Neither rare words nor copies of one text give an entity away; three texts do, in a table of any size."""
    rng = np.random.default_rng(11)
    rows = [(0, "the river Zaphodia wrote about zaph@mail.example.com of stone")] * 5
    rows += [(k, f"{prose(rng, 5)} Trillia {prose(rng, 5)} trill@else.example.org {k}") for k in (1, 2, 3)] + [(k, f"{prose(rng, 5)} Fordia ford@third.example.net {k}") for k in (4, 5)]
    rows += [(i, prose(rng, 40) + f" wrote about word{i}") for i in range(6, n)]
    text = dict(rows)
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("spans", pii.span_text()).collect()
    marked = {(r.doc_id, text[r.doc_id][x["start"] : x["end"]]) for r in got for x in r.added or []}
    assert marked == {(k, "Trillia") for k in (1, 2, 3)}


def test_groups_of_entities(spark):
    assert pii.entities([(0, 0, 5, "a@x.org"), (9, 1, 20, "10.0.0.7"), (30, 3, 44, "15555550199")]) == ["email-group:x.org", "email:a@x.org", "ip-group:10.0.0", "ip:10.0.0.7", "phone-group:155555", "phone:15555550199"]
    rng = np.random.default_rng(2)
    rows = [(i, f"{prose(rng, 9)} Betelgeuse{'!' * (i % 2)} user{i}@corp.example {prose(rng, 9)}") for i in range(12)] + [(100 + i, prose(rng, 30)) for i in range(60)]
    text = dict(rows)
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {text[r.doc_id][x["start"] : x["end"]] for r in got for x in r.added or []} == {"Betelgeuse", "Betelgeuse!"}
    assert pii.fewest_texts(1.0) == 3


def test_sanitised_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "call +1 (555) 555-0199 now", "a", "b", "c", "d"), (2, "none", "e", None, "g", "h")], "doc_id long, text string, pii_digest string, digest string, added string, row string")
    got = rows_of(pii.sanitised(df))
    assert tuple(got[1]) == (1, "call <PHONE> now", "a", "b", "c", "d") and tuple(got[2]) == (2, "none", "e", None, "g", "h")


def test_terms_anywhere_in_a_text(spark):
    """Terms far from the entity, of any length, at each of their places; pairs equal those of a plain loop."""
    rng = np.random.default_rng(12)
    long = "Z" * 60
    rows = [(k, f"Zaphodia {long} {prose(rng, 60)} zaph@mail.example.com {prose(rng, 60)} the zaphodia,end Zaphodia") for k in (0, 900, 901)]
    rows += [(1 + i, f"Trillia {prose(rng, 30)} 10.0.0.{i % 7} and trill@mail.example.com {prose(rng, 30)} mark{i % 5}") for i in range(20)]
    rows += [(100 + i, prose(rng, 40) + (" mark3" if i < 3 else "")) for i in range(700)] + [(0, rows[0][1])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.detect(df).withColumn("spans", pii.span_text()).collect()
    first = {r.spans for r in got if r.doc_id == 0}
    assert len(first) == 1
    text = dict(rows)
    marked = [text[0][int(a) : int(b)] for k, a, b in (s.split(":") for s in first.pop().split(",")) if k == "term"]
    assert marked == ["Zaphodia", long, "zaphodia,end", "Zaphodia"]
    base = {t: pii.base_spans(t) for t in text.values()}
    held = {t: set(pii.entities(b)) for t, b in base.items()}
    words = {t: {pii._lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)} for t in base}
    every = [t for _, t in rows]
    n_t = Counter(w for t in every for w in words[t])
    free = {t: {pii._lower(t[a:b]) for a, b in pii.free_words(t, base[t])} for t in base}
    n_te, m_te = (Counter((e, w) for t in ts for e in held[t] for w in free[t]) for ts in (every, set(every)))

    def unsaid(e, w):
        p, n, z = n_te[e, w] / n_t[w], n_t[w] * m_te[e, w] / n_te[e, w], 1.645
        return -math.log2((p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))

    some = 0
    for r in got:
        t = text[r.doc_id]
        want = sorted((a, b) for a, b in pii.free_words(t, base[t]) if any(unsaid(e, pii._lower(t[a:b])) <= 1 for e in held[t]))
        some += len(want)
        assert sorted((x["start"], x["end"]) for x in r.added or []) == want
    assert some > 20


@pytest.mark.parametrize("percent", [85, 60])
def test_minhash_near_duplicates(spark, docs, texts, empty, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, percent).collect()}
    assert got == brute.near_duplicates(texts, percent)
    assert minhash_dedup.near_duplicates(empty).count() == 0
    null = minhash_dedup.near_duplicates(spark.createDataFrame([(None, texts[3]), (3, texts[3])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in null) == [(False, 3, True), (True, None, True)]


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.choice(WORDS, 120)
    docs = {}
    for i in range(90):
        w = base.copy()
        w[rng.integers(0, 120, int(rng.integers(0, 6)))] = f"w{i}"
        docs[i] = " ".join(w)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 85).collect()}
    assert got == brute.near_duplicates(docs, 85)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for n, share in ((400, 0.5), (400, 0.85), (30, 0.8)):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        k = int(n * share)
        a, b = np.unique(both[:k].tolist() + rng.integers(0, 1 << 63, (n - k) // 2).tolist()).astype(np.uint64), np.unique(both[:k].tolist() + rng.integers(0, 1 << 63, (n - k) - (n - k) // 2).tolist()).astype(np.uint64)
        s = minhash_dedup.sketches([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash_dedup.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert got == pytest.approx(true, abs=0.16)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 540)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(12)
    good = {i: prose(rng, 90) for i in range(30)}
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in good.items()]
    rows += [(100, good[1] + " more", "en", "s0", 1), (101, good[2], "en", "s1", 1), (102, "buy!! NOW!! " * 60, "en", "s1", 1), (103, "short", "en", "s0", 1), (104, prose(rng, 80) + " write to someone@mail.example.com today.", "en", None, 1), (None, prose(rng, 70), None, "s0", None), (105, None, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    at = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = lambda n: sorted((r.doc_id for r in at[n].collect()), key=lambda x: (x is None, x))
    assert ids("quality_rules") == [*range(30), 100, 101, 104, None]
    assert ids("minhash_dedup") == [*range(30), 104, None]
    assert any("<EMAIL>" in r.text for r in at["pii"].collect()) and ids("pii") == ids("minhash_dedup")
    total = at["pii"].select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert at["mixing"].select(F.sum(mixing.size_of(F.col("text")))).first()[0] == pytest.approx(1.5 * total, rel=0.1)
    codec = _codec()
    texts = Counter(r.text for r in at["mixing"].collect())
    assert Counter(codec.decode(list(r.ids)) for r in at["sentencepiece"].collect()) == texts
    assert cp.run(spark, f"{tmp_path}/sf").count() == at["sentencepiece"].count()
