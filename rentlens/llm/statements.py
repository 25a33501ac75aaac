"""DuckDB SQL for the rows of the queries that SQL can express; used for checking only."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\t'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\t')) + length('### : </turn>') + 1 AS chars
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS masked,
    sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256, formatted_chars
FROM g
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5),
v AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM p),
r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(5) t(k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (
  SELECT doc_id, text, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols * 100 <= n_words * 50
    AND (length(text) - length(replace(text, '!', ''))) * 100 <= n_words * 50
    AND word_chars >= 2 * n_words AND word_chars <= 25 * n_words
    AND n_dup_lines * 100 <= len(lines) * 50
    AND (length(text) - length(replace(text, '?', ''))) * 100 <= n_words * 50
    AND (length(text) - length(translate(text, '0123456789', ''))) * 100 <= length(text) * 40
    AND (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 100 <= length(text) * 70
    AND (length(text) - length(translate(text, '{{}}', ''))) * 100 <= length(text) * 5
    AND (length(text) - length(replace(text, chr(65533), ''))) * 100 <= length(text)
    AND len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) * 100 <= (len(lines) + 3) * 90
    AND len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*\z'))) * 100 <= (len(lines) + 3) * 50
    AND coalesce(list_max(list_transform(words, lambda x: length(x))), 0) <= 500
    AND len(list_distinct(words)) * 100 >= len(words) * 2 AS kept
FROM (SELECT *, string_split(text, chr(10)) AS lines FROM b)
"""

REPEATS = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, j, substr(h, 1000 * j + 1, 1098) AS part
  FROM b, LATERAL (SELECT unnest(range(length(h) // 1000 + 1)) AS j)),
w AS (
  SELECT doc_id, 500 * j + k AS i, substr(part, 2 * k + 1, 100) AS s
  FROM c, LATERAL (SELECT unnest(range(least(500, length(part) // 2 - 49))) AS k)),
f AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
g AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS fresh FROM f),
k AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY ALL),
q AS (SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
t AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS stop,
    string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head
  FROM q JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH items AS (SELECT item_id, {TERMS} AS words FROM benchmark),
pieces AS (
  SELECT item_id, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i, words
  FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS w FROM pieces),
docs AS (SELECT doc_id, {TERMS} AS words FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM docs, (SELECT DISTINCT size FROM windows), LATERAL (SELECT unnest(range(1, len(words) - size + 2)) AS i)),
hits AS (SELECT doc_id, p.size, i, item_id FROM places p JOIN windows USING (size, w)),
words_hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, LATERAL (SELECT unnest(range(size)) AS k) GROUP BY 1),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {TERMS} AS words FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, {TERMS} AS words FROM benchmark),
q AS (SELECT i, term, count(*) AS qtf FROM (SELECT i, unnest(words) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d),
t AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM t, s GROUP BY term),
m AS (SELECT d, doc_id, 75 + (25 * len(words) * n_docs) // n_terms AS m FROM d, s),
p AS (
  SELECT i, d, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (d) GROUP BY ALL),
r AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM p JOIN m USING (d) WHERE score > 0 QUALIFY rank <= 20)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (i)
"""

STATEMENTS = {
    "op1_warc": WARC,
    "op3_chat": CHAT,
    "op4_quality": QUALITY,
    "op7_repeats": REPEATS,
    "op8_decontamination": DECONTAMINATION,
    "op11_lexical_search": LEXICAL,
}
