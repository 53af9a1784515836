"""DuckDB SQL for the operators' queries that SQL can express.

The others need a tokenizer (1, 8), a fitted model (6, 9), a hash that the engine lacks (10), MinHash candidates (3) or
eigenvectors (11):
tests hold them against brute force or held-out rows.
"""

OP2 = r"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
d AS (SELECT host, path, arg_max(concat(h, p), length(concat(h, p))) AS rule, arg_max(v, length(concat(h, p))) AS verdict FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN d ON u.host = d.host AND u.path = d.path"""

OP4 = r"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, t, i, concat_ws(chr(1), w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, t, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS mean, var_pop(f / n) AS v, avg(1 / n) AS s, sum(n) AS total FROM h),
q AS (SELECT mean, greatest(1, least(total, CASE WHEN v - mean * (1 - mean) * s > 0 THEN mean * (1 - mean) / (v - mean * (1 - mean) * s) - 1 ELSE total END)) AS k FROM m),
bad AS (SELECT source FROM h, q WHERE (f + mean * k) / (n + k) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM b"""

OP5 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

#: Base32 takes five bits at a time: five hexadecimal digits make four letters.
OP7 = r"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS largest FROM p GROUP BY h),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1), '' ORDER BY k, s DESC) AS digest
    FROM (SELECT h, k, CAST(concat('0x', substr(h, CAST(5 * k + 1 AS INTEGER), 5)) AS BIGINT) AS v FROM g, range(8) r(k)), unnest([15, 10, 5, 0]) t(s) GROUP BY h)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < largest THEN largest END AS refers_to FROM p JOIN g ON p.h = g.h JOIN b ON p.h = b.h"""


OP12 = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id AS of, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM t LEFT JOIN l ON doc_id = of),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, concat(chr(64 + a.i), chr(64 + b.i), chr(64 + c.i), chr(64 + d.i), chr(64 + e.i)) AS filter_order FROM k a, k b, k c, k d, k e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, filter_order, o, fails, n, good, toxic, coalesce(list_position([fails[o[1]], fails[o[2]], fails[o[3]], fails[o[4]], fails[o[5]]], true), 6) AS gone FROM m, o),
r AS (SELECT part, filter_order, i AS step, o[i] AS f, sum(CASE WHEN gone > i THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = i THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone < i AND fails[o[i]] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[o[i]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = i THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = i THEN toxic ELSE 0 END) AS toxic_lost
    FROM s, k GROUP BY part, filter_order, o, i)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

OP13 = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(g.t) AS text_sha256 FROM t JOIN g ON t.t = g.t"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2, "op4_quality_rules": OP4, "op5_decontamination": OP5, "op7_warc": OP7, "op12_filter_audit": OP12, "op13_exact_dedup": OP13}
