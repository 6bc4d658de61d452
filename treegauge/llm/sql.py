"""The same results in SQL, for the operators that SQL can express."""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < newest THEN newest END AS refers_to
FROM p LEFT JOIN m ON p.digest = m.digest AND n >= 1000"""

QUALITY_RULES = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM a) GROUP BY doc_id),
o AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(words) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
f AS (SELECT w.doc_id, w.text, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(o.n, 0) AS most,
  strlen(w.text) - strlen(regexp_replace(w.text, '[A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters,
  length(regexp_replace(w.text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(w.text, '[^a-z]', '', 'g')) AS lower,
  length(regexp_replace(w.text, '[^!]', '', 'g')) AS cries
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words) OR 2 * letters < strlen(text) OR upper > lower
    OR 5 * cries > n_words OR 10 * most > 4 * n_words) AS kept FROM b"""

LEXICAL = r"""WITH w AS (SELECT rn, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rn, doc_id, text FROM documents)),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT rn, doc_id, count(*) AS n FROM w GROUP BY rn, doc_id),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT rn, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY rn, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, text, d.rn, any_value(d.doc_id) AS doc_id, CAST(sum(t.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN t USING (term) JOIN d ON d.rn = p.rn, c GROUP BY item_id, text, d.rn),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
