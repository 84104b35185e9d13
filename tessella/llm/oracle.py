"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

_URL = """
u AS (SELECT page_id, url, position('://' IN coalesce(url, '')) AS scheme_end FROM pages),
r AS (SELECT page_id, CASE WHEN scheme_end > 0 THEN substr(url, scheme_end + 3) ELSE '' END AS rest FROM u),
s AS (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)"""

SQL["op3_url_filters"] = f"""
WITH {_URL},
f AS (SELECT page_id, host, path,
        (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS f1,
        (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS f2,
        (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS f3,
        (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS f4 FROM s)
SELECT page_id, host, path,
  CASE WHEN f2 THEN 'example.net/en/' WHEN f3 THEN 'example.com/de/' WHEN f4 THEN 'org/fr/' WHEN f1 THEN 'net/' END AS rule,
  CASE WHEN f2 THEN 'allow' WHEN f3 THEN 'block' WHEN f4 THEN 'allow' WHEN f1 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op8_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM r) GROUP BY 1),
f AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT doc_id, source, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS d, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS k FROM b GROUP BY 1),
p AS (SELECT sum(k) / sum(d) AS m, var_pop(k / d) AS v, avg(1.0 / d) AS inv FROM h),
q AS (SELECT m, CASE WHEN v > m * (1 - m) * inv THEN least(1000.0, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) ELSE 1000.0 END AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (k + m * s) / (d + s) <= 0.5 AS kept
FROM b JOIN h ON h.source IS NOT DISTINCT FROM b.source, q
"""

SQL["op5_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
d AS (SELECT doc_id, i AS f, i + 34 AS l FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
e AS (SELECT doc_id, p, sum(x) AS x FROM (SELECT doc_id, f AS p, 1 AS x FROM d UNION ALL SELECT doc_id, l + 1, -1 FROM d) GROUP BY 1, 2),
k AS (SELECT u.doc_id, u.p, word, sum(coalesce(x, 0)) OVER (PARTITION BY u.doc_id ORDER BY u.p) > 0 AS gone FROM u LEFT JOIN e ON e.doc_id = u.doc_id AND e.p = u.p),
s AS (SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY p) AS kept FROM k GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""

SQL["op2_near_dedup"] = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

#: The unsigned crc32 of a conversation's decimal id, bit by bit.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""

SQL["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
        strlen(coalesce(text, '')) AS b, md5(concat(length(coalesce(role, '')), ':', role, text)) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, len, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT conv_id, count(*) AS len FROM t GROUP BY 1)),
d AS (SELECT c.conv_id, c.len, c.base, c.h, least(c.h, coalesce(o.len, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.base),
r AS (SELECT d.conv_id, t.i, t.b, t.k FROM d JOIN t ON t.conv_id = d.base AND t.i <= d.taken
      UNION ALL SELECT d.conv_id, t.i - d.h + d.taken, t.b, t.k FROM d JOIN t ON t.conv_id = d.conv_id AND t.i > d.h),
m AS (SELECT conv_id, taken + greatest(len - h, 0) AS n FROM d),
p AS (SELECT conv_id, i, b, md5(string_agg(k, ',') OVER w) AS key, md5(string_agg(k, ',') OVER v) AS up FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY i), v AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT conv_id, i, b, key, coalesce(up, 'root') AS up FROM p UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM m),
n AS (SELECT key, any_value(up) AS up, any_value(i) AS depth, any_value(b) AS b, min(q.conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(q.conv_id AS VARCHAR), ',' ORDER BY q.conv_id) FILTER (WHERE m.n = q.i), '')) AS ends_sha256
      FROM q JOIN m ON m.conv_id = q.conv_id GROUP BY key),
k AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT q.key, sum((n.n_convs - 1) * n.b) AS saved, count(*) FILTER (WHERE k.up IS NULL) AS leaves
      FROM n LEFT JOIN k ON k.up = n.key JOIN q ON q.conv_id = n.conv_id AND q.i <= n.depth GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n o ON o.key = n.up LEFT JOIN k ON k.up = n.key JOIN s ON s.key = n.key
"""

SQL["op12_source_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, term, count(*) AS c FROM (SELECT id, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept ON kept.lang = l.lang GROUP BY 1),
c AS (SELECT g.lang, g.source, kept.term, coalesce(x.c, 0) AS c FROM g JOIN kept ON kept.lang = g.lang
      LEFT JOIN (SELECT lang, source, term, sum(c) AS c FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = kept.term),
s AS (SELECT lang, source, term, c, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang, term) AS lc, sum(c) OVER (PARTITION BY lang) AS ln FROM c),
p AS (SELECT s.lang, source, term, c, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (n + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lc + 5)) // (ln + 5 * v) AS q FROM s JOIN v ON v.lang = s.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
o AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
