"""DuckDB SQL for the queries that SQL can express over whole tables.

Packing, HTML extraction, the classifier and token counts need a tokenizer, a parser or a model; tests hold those queries
against brute force instead.
"""

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {WORDS.format("text")} AS ws FROM d),
n AS (SELECT r, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars FROM w),
g AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM again, range(5) t(k) GROUP BY 1),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE len({WORDS.format("line")}) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY 1),
k AS (SELECT r, doc_id, source, len(ws) AS nw, lower(array_to_string(CASE WHEN 2 * len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+'))) < len(ws) THEN list_transform(ws, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' ELSE x END) ELSE ws END, ' ')) AS key FROM (SELECT l.r, d.doc_id, d.source, {WORDS.format("l.line")} AS ws FROM l JOIN d USING (r))),
common AS (SELECT coalesce(source, chr(0)) AS s, key FROM k GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT k.r, sum(nw) AS gone FROM k JOIN common c ON coalesce(k.source, chr(0)) = c.s AND k.key = c.key GROUP BY 1),
o AS (SELECT d.doc_id, n_words, word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(gone, 0) AS gone FROM d JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(gone AS BIGINT) AS n_removed_words, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - gone >= 10 AND n_words - gone >= 0.5 * n_words AS kept FROM o
"""

OP4 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("text")}) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rk % 3 + 1] AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM r),
lv AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN cap > w * level THEN w * (SELECT level FROM lv WHERE cap > w * level ORDER BY cap / w, rk LIMIT 1) ELSE cap END AS target FROM lv),
u AS (SELECT d.*, t.source_size, t.target, t.rk, sum(size) OVER (PARTITION BY d.source ORDER BY key, CAST(doc_id AS VARCHAR)) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, rk, key, (upto + k * source_size) / target AS finish FROM u, range(3) q(k) WHERE size > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, key, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM c),
x AS (SELECT doc_id, sum(size) AS taken FROM m WHERE spent <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT u.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM u LEFT JOIN x USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT r, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON p.x = a.r JOIN n b ON p.y = b.r WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
s AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c(r, z) AS (SELECT r, r FROM n UNION SELECT c.r, s.y FROM c JOIN s ON c.z = s.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN d o ON c.z = o.r GROUP BY d.r, d.doc_id, n.n
"""

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT r, doc_id, source, {kind} AS kind, i, value, sum(gap + size) OVER (PARTITION BY r ORDER BY i) - size AS s, sum(gap + size) OVER (PARTITION BY r ORDER BY i) AS e, length(value) >= {least} AS ok
    FROM (SELECT r, doc_id, source, i, v[i] AS value, length(m[i]) AS size, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, doc_id, source, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS g FROM d)))"""


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text FROM documents),
t AS ({_spans(0, _ASSIGN, 1, 6)} UNION ALL {_spans(1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans(2, "[0-9a-f]+", 0, 24)} UNION ALL
SELECT * FROM ({_spans(3, "[A-Za-z0-9+/_-]+", 0, 20)}) WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND len(list_distinct(string_split(value, ''))) >= 12),
k AS (SELECT * FROM t WHERE ok),
f AS (SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k b WHERE b.r = k.r AND b.kind < 3 AND b.s < k.e AND k.s < b.e)),
o AS (SELECT value, count(DISTINCT source) AS owners FROM f GROUP BY 1),
j AS (SELECT f.*, owners FROM f JOIN o USING (value) WHERE kind < 3 OR owners = 1),
a AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_owner, count(*) FILTER (WHERE owners >= 3) AS n_example, count(*) FILTER (WHERE owners = 1) AS n_live,
string_agg(['assign', 'access', 'hex', 'owner'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) AS spans, string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owner, 0) AS n_owner, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN a USING (r)
"""

OP8 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(x, lambda z: z <> 0)) > 0),
e AS (SELECT a.r AS p, b.r AS q FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
c(r, z) AS (SELECT r, r FROM v UNION SELECT c.r, e.q FROM c JOIN e ON c.z = e.p),
m AS (SELECT c.r, min(o.vec_id) AS component_id FROM c JOIN v o ON c.z = o.r GROUP BY 1), n AS (SELECT p AS r, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(CAST(CAST(from_hex(hex) AS BIT) AS VARCHAR), CAST(i * 5 + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

ORACLES: dict[str, str] = {
    "op3_line_frequency": OP3,
    "op4_mixing": OP4,
    "op5_shingle_links": OP5,
    "op6_secrets": OP6,
    "op8_vector_links": OP8,
    "op10_warc": OP10,
}
