"""DuckDB SQL with the same rows as the queries, where SQL can say it."""

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(ln.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(ln.n_lines, 0) AS n_lines,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
        length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
        length(text) - length(replace(text, '!', '')) AS n_exclaims
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, CAST(
        CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * n_letters AND n_letters > 0 THEN 8 ELSE 0 END
      + CASE WHEN 100 * n_exclaims > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""

OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
z AS (SELECT *, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g')) AS marks FROM d),
k AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, size,
        -ln((CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0)
        / CASE WHEN size > 0 THEN CAST(size AS DOUBLE) / CAST(size + marks AS DOUBLE) ELSE 1.0 END AS key FROM z),
s AS (SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1, 2),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY none, src) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER (ORDER BY ratio, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
f AS (SELECT arg_min(level, (ratio, none, src)) AS level FROM l WHERE ratio >= level),
t AS (SELECT none, src, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * w) END AS target FROM l, f),
e AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
        CAST(sum(size) OVER (PARTITION BY none, src ORDER BY key, coalesce(CAST(doc_id AS VARCHAR), ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
      FROM k JOIN t USING (none, src))
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS taken FROM e
"""

_REACH = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS least FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node AND r.least < e.b),
c AS (SELECT node, min(least) AS least FROM r GROUP BY 1)"""

OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.9),
{_REACH},
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
{_REACH}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS target FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id IS DISTINCT FROM target AND target IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to FROM m
"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM d)),
g AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS z(k) WHERE len(ws) >= k)),
t AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
f AS (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT f.lang, f.k, f.g, f.f AS a, cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * f.f) // (x.f + y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) f JOIN f x ON x.lang = f.lang AND x.g = f.g[1:cut] JOIN f y ON y.lang = f.lang AND y.g = f.g[cut + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, g[s:s + n - 1] AS g, max(f) AS f FROM (SELECT *, unnest(range(1, k - n + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS n FROM f WHERE k > 2)) GROUP BY ALL),
o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE i.f IS NULL OR 100 * i.f < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang)
QUALIFY rank <= 2000
"""

_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))), lambda c, x: " + "({})" + ")"
_STEP = "xor({0} >> 1, 3988292384 * ({0} & 1))"


def _crc_sql() -> str:
    """CRC-32 of the bytes that the hexadecimal text h spells: the table's entry of each low byte, then eight bits on."""
    return "xor(" + _CRC.format("xor(c >> 8, crc[1 + xor(c & 255, x)])") + ", 4294967295)"


OP13 = rf"""
WITH RECURSIVE e AS (SELECT b, 0 AS s, CAST(b AS BIGINT) AS v FROM range(256) z(b) UNION ALL SELECT b, s + 1, {_STEP.format('v')} FROM e WHERE s < 8),
tab AS (SELECT list(v ORDER BY b) AS crc FROM e WHERE s = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
k AS (SELECT w, {_crc_sql()} % 10000 AS bucket FROM (SELECT w, lower(hex(encode(w))) AS h, crc FROM (SELECT w FROM dw UNION SELECT w FROM q), tab)),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM q JOIN k USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) AS DOUBLE) / CAST((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""

ORACLES = {"op4_mixing": OP4, "op1_quality_rules": OP1, "op8_embedding_dedup": OP8, "op10_minhash_dedup": OP10, "op11_warc": OP11, "op12_phrase_mining": OP12, "op13_importance_resampling": OP13}
