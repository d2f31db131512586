"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g WHERE n = 8),
p AS (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS c FROM r WHERE again),
rep AS (SELECT doc_id, sum(c) AS n_repeat_words FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim
      FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
             | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN 2 * word_chars < 5 * n_words THEN 8 ELSE 0 END)
             | (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) | (CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END)
             | (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) | (CASE WHEN 10 * n_exclaim > n_words THEN 256 ELSE 0 END) AS v1 FROM m),
f AS (SELECT b.*, v1 | (CASE WHEN 10 * n_dup_lines > 3 * len(lines) THEN 32 ELSE 0 END) AS fail_bits FROM b JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (v1 & 3) <> 0 AS base_failed, v1 = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM f
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""

OP3 = r"""
WITH a AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', chr(10), 'g'),
    '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|article|section|nav|header|footer|title|body|html|head|main|aside|pre|blockquote)\b[^>]*>', chr(10), 'g'),
    '<[^>]*>', '', 'g') AS t FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS lines FROM a),
h AS (SELECT host, count(*) AS pages FROM l WHERE host IS NOT NULL GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l WHERE host IS NOT NULL) GROUP BY ALL),
k AS (SELECT host, list(line) AS drops FROM c JOIN h USING (host) WHERE n > 1 AND n > 0.3 * pages GROUP BY host),
f AS (SELECT page_id, l.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(drops, x), false)) AS rest FROM l LEFT JOIN k ON l.host = k.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(rest))::BIGINT AS n_dropped, array_to_string(rest, chr(10)) AS text FROM f
"""

OP4 = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * k >= 75 * (n + m - k)),
r AS (SELECT doc_id AS d, doc_id AS z FROM documents UNION SELECT r.d, l.y FROM r JOIN l ON r.z = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.c AS component_id FROM s JOIN (SELECT d, min(z) AS c FROM r GROUP BY d) c ON c.d = s.doc_id
"""

OP12 = """
WITH l AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT c, s, list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS bits FROM l),
k AS (SELECT c, s, xor(4294967295, list_reduce(bits, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h FROM b),
r AS (SELECT k.c, list_concat(coalesce(l.s[1:h], []), k.s[h + 1:]) AS s FROM k LEFT JOIN l ON l.c = k.c - k.c % 100),
p AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY d, p),
q AS (SELECT n.*, coalesce(k.n, 0) AS n_children, o.conv_id AS parent_conv_id FROM n LEFT JOIN (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL) k ON k.d = n.d AND k.p = n.p
      LEFT JOIN n o ON o.d = n.d - 1 AND o.p = n.p[1:n.d - 1] AND n.d > 0),
u AS (SELECT a AS d, p[1:a] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].x) END) AS saved_tokens
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM q) GROUP BY ALL)
SELECT q.conv_id, q.d AS depth, q.parent_conv_id, q.n_convs, q.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, q.ends_sha256 FROM q JOIN u ON u.d = q.d AND u.p = q.p
"""

OP11 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
g AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
v AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM v) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, g.n),
s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * p.n * g.n) // g.l))))::BIGINT AS score FROM v JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

OP13 = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
r AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE again),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM e ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_line_dedup": OP3, "op4_ngram_join": OP4, "op8_warc": OP8, "op10_quality_rules": OP10, "op11_lexical_search": OP11, "op12_conversation_trie": OP12, "op13_substring_dedup": OP13}
