"""WARC archives, phrase mining and importance resampling against plain versions."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import common, importance_resampling, phrase_mining, warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(11)
    body = lambda n: "<html><body>" + "".join(f"<p class='x'>{' '.join(rng.choice(['stone', 'river', 'éclat', 'cloud'], 8))}</p>" for _ in range(n)) + "</body></html>"
    copy, long = body(30), body(20_000)
    rows = [(i, f"http://a.example/{i}?q=a b%20\r\nc", body(int(rng.integers(1, 40)))) for i in range(120)]
    rows += [(200 + i, None, copy) for i in range(40)] + [(300, "u", None), (301, "u", ""), (302, "u", ""), (None, "u", copy), (None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    rows += [(310, "u", "é" * 499), (311, "u", "é" * 499), (312, "u", "é" * 500), (313, "u", "é" * 500), (320, "u", long), (320, "u", long), (319, "u", long), (319, "u", long), (320, "u", "other" * 300)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, target string").repartition(5)


def plain_pages(rows):
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            best[h] = max(i, best.get(h, i))
    for i, u, h in rows:
        h = (h or "").encode()
        t = best.get(h)
        again = t is not None and i != t
        yield i, u, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", t if again else None


def order(rows):
    return sorted(rows, key=repr)


def test_warc_round_trip(spark, pages, tmp_path):
    rows, df = pages
    index = warc.write(df, f"file://{tmp_path}/w", file_bytes=200_000)
    back = warc.read(index).collect()
    to_int = lambda x: None if x is None else int(x)
    assert order((to_int(r.id), r.url, r.payload_bytes, r.payload_digest, r.record_type, to_int(r.refers_to)) for r in back) == order(plain_pages(rows))
    whole = warc.with_payloads(warc.read(index)).collect()
    assert order((to_int(r.id), bytes(r.payload)) for r in whole) == order((i, (h or "").encode()) for i, _, h in rows)
    assert {r.path for r in index.collect()} == {r.path.replace("file:/", "file:///") if "///" not in r.path else r.path for r in warc.archives(spark, f"file://{tmp_path}/w").collect()}
    for r in index.where("id is not null").limit(20).collect():
        assert warc.read_record(r.path, r.offset, r.length)[0] == r.id


def test_warc_files_start_with_their_dictionary(spark, pages, tmp_path):
    index = warc.write(pages[1].coalesce(1), f"file://{tmp_path}/w")
    (path,) = {r.path for r in index.collect()}
    data = open(urlparse(path).path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    held = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert held[:4] == struct.pack("<I", 0xEC30A437)
    unpress, rest, records = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), data[8 + size :], []
    while rest:  # one record in each frame
        one = unpress.decompressobj()
        records.append(one.decompress(rest))
        rest = one.unused_data
    assert len(records) == len(pages[0]) + 1 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - 8 - size < alone


def test_warc_detects_damage(spark, pages, tmp_path):
    record = warc.record("1", "u", b"payload", hashlib.sha1(b"payloaX").digest(), None, "1970-01-01T00:00:00Z")
    import io

    with pytest.raises(ValueError):
        list(warc.parsed(io.BufferedReader(io.BytesIO(record))))
    with pytest.raises(ValueError):
        list(warc.parsed(io.BufferedReader(io.BytesIO(record[:-9]))))


def test_warc_of_an_empty_table_and_text_ids(spark, pages, tmp_path):
    index = warc.write(pages[1].limit(0), f"file://{tmp_path}/e")
    assert index.count() == 0 and warc.read(index).count() == 0
    df = spark.createDataFrame([("a%0A\nb", "u", "x"), ("", None, "y")], "page_id string, url string, html string")
    assert {(r.id, r.url, bytes(r.payload)) for r in warc.read(warc.write(df, f"file://{tmp_path}/t")).collect()} == {("a%0A\nb", "u", b"x"), ("", None, b"y")}


def test_packed_ids_give_back_every_row(spark, monkeypatch):
    rows = [(bytes([i % 7]) if i % 3 else b"hot", i if i % 11 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "k binary, i long").repartition(3)
    packs = common.packed_ids(df)
    assert packs.count() < 60
    assert order((bytes(r.key), r.i) for r in packs.select("key", F.explode("ids").alias("i")).collect()) == order(rows)


LOWER = {c: c + 32 for c in range(65, 91)}


def plain_phrases(rows, min_count, top=2000, most=4):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= min_count}
        inside = defaultdict(int)
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and not 100 * inside[p] >= 80 * a:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.fixture(scope="module")
def prose(spark):
    rng = np.random.default_rng(5)
    words = ["the", "Of", "new", "york", "é", "日本", "a-b", "x" * 80, "stone", " ", "ice", "cream"]
    words += [f"w{k}" for k in range(60)]
    p = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(400):
        w = rng.choice(words, int(rng.integers(1, 90)), p=p / p.sum())
        seps = rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; ", "?"], len(w), p=[0.6, 0.1, 0.1, 0.05, 0.03, 0.03, 0.03, 0.03, 0.03])
        rows.append((["en", "fr", None, "und"][i % 4], "".join(a + b for a, b in zip(w, seps))))
    rows += [("en", "ice cream " * 5000), ("en", None), (None, ""), ("fr", " ,\n"), ("zz", "one two")] + [("fr", "New York is new york")] * 90
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, key string").repartition(6)


@pytest.mark.parametrize("held,block", [(phrase_mining.HELD_WINDOWS, phrase_mining.BLOCK_BYTES), (300, 2000)])
def test_phrases_equal_a_plain_count(spark, prose, held, block):
    rows, df = prose
    got = phrase_mining.collocations(df, min_count=30, held_windows=held, block_bytes=block)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    want = plain_phrases(rows, 30)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 50


def test_top_phrases_and_empty_table(spark, prose):
    rows, df = prose
    assert sorted(tuple(r) for r in phrase_mining.collocations(df, min_count=40, top=5).collect()) == sorted(plain_phrases(rows, 40, 5))
    assert phrase_mining.collocations(df.limit(0)).count() == 0
    assert phrase_mining.collocations(df, min_count=10**6).count() == 0


def test_scores_pass_64_bits(spark):
    key = lambda *ids: b"".join(i.to_bytes(phrase_mining.WIDTH, "big") for i in ids)
    a, left, right = 3 * 10**18, 4 * 10**18, 5 * 10**18
    counts = spark.createDataFrame([(key(1), 1, left), (key(2**39), 1, right), (key(1, 2**39), 2, a)], "key binary, words int, f long")
    r = phrase_mining.scored(counts).first()
    assert (r.a, r.l, r.r, r.score) == (a, left, right, 2000000 * a // (left + right))


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << int(b), 5000, dtype=np.uint64) for b in (3, 40, 17, 0)]
    assert phrase_mining.radix_order(columns).tolist() == np.lexsort(columns[::-1]).tolist()
    assert phrase_mining.radix_order([np.zeros(0, np.uint64)] * 2).tolist() == []


def plain_resampling(docs, target, n=1, buckets=10_000, percent=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def found(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    of = [found(t) for _, t in docs]
    s, t = Counter(b for _, bs in of for b in bs), Counter(b for x in target for b in found(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (i, _), (words, bs) in zip(docs, of):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        rows.append([words < 20, -(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), i is None, i or 0, len(bs), weight])
    drawn = percent * sum(not r[0] for r in rows) // 100
    return [(None if none else i, size, weight, -score, k if k <= drawn else None) for k, (_, score, none, i, size, weight) in enumerate(sorted(rows), 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_a_plain_version(spark, n):
    rng = np.random.default_rng(8)
    words = ["the", "Of", "éa", "日本", "x1", "stone", "ice", "--", "a", "42", *(f"w{k}" for k in range(40))]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 70))))) for i in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(150)] + [(2000, None), (2001, ""), (None, docs[2][1]), (2002, "the " * 60_000), (2003, "THE,the"), (5, docs[5][1])]
    target = ["stone ice w1 w2 w3", "Stone-stone", None, ""]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, weight string, id string").repartition(5)
    b = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = importance_resampling.resample(df, b, n=n)
    assert {t for _, t in got.dtypes} == {"bigint"} and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # rows that share their id and text share all but the rank
    assert order(tuple(r) for r in got.collect()) == order(plain_resampling(docs, target, n))
    kept = {r.doc_id for r in importance_resampling.drawn_rows(df, b, n=n).collect()}
    assert kept == {r[0] for r in plain_resampling(docs, target, n) if r[4] and r[0] is not None}


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string")
    none = docs.select("text").limit(0)
    assert importance_resampling.resample(docs.limit(0), docs.select("text")).count() == 0
    assert order(tuple(r) for r in importance_resampling.resample(docs, none).collect()) == order(plain_resampling([(1, "a " * 30), (2, "b")], []))
