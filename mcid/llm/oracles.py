r"""SQL checks of the queries, written from their contracts."""

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS n,
    lag(role) OVER w IS NOT DISTINCT FROM role AS joined, lead(role) OVER w IS NOT DISTINCT FROM role AS joins
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN joined THEN 7 ELSE 6 + length(role) END + CASE WHEN joins THEN 0 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), win AS (
  SELECT r, p, list_slice(w, p, p + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d)
), rep AS (
  SELECT r, count(DISTINCT p + k) AS n FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win), range(5) q(k)
  WHERE c > 1 GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    10 * n_symbols > n_words OR n_dup_lines > 2 OR word_chars > 12 * n_words OR word_chars < 2 * n_words AS soft
  FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft)::DOUBLE AS x FROM f GROUP BY source
), a AS (
  SELECT sum(x) / sum(n) AS mean, sum(x * (x / n)) / sum(n) AS sq, count(*) / sum(n) AS per FROM h
), k AS (
  SELECT mean, greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * per, 1e-6) - 1, 1) AS strength FROM a
), v AS (
  SELECT source, (x + strength * mean) / (n + strength) > 0.5 AS strict FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (strict AND soft) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

SUBSTRINGS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), win AS (
  SELECT r, doc_id, p, list_slice(w, p, p + 12) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)
), low AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g
), lost AS (
  SELECT r, list(DISTINCT p + k) AS ps FROM win JOIN low USING (g), range(13) q(k) WHERE doc_id > m GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""

SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), s AS (
  SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d
), tok AS (
  SELECT r, doc_id, len AS dl, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tok GROUP BY term
), q AS (
  SELECT DISTINCT doc_id AS query_id, term FROM tok WHERE doc_id % 100 = 0
), hit AS (
  SELECT query_id, r, doc_id, sum(round((1e6::DOUBLE * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)))
    * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))))::BIGINT)::BIGINT AS score
  FROM q JOIN tok USING (term) JOIN df USING (term), s GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM hit
)
SELECT * FROM ranked WHERE rank <= 10
"""

WARC = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first, unhex(h)::BIT::VARCHAR AS bits FROM p
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = rf"""
WITH d AS (
  SELECT doc_id, {LOWER} AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), x AS (
  SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1)::UBIGINT AS x1, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1)::UBIGINT AS x2,
    ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(x1, x2)::BIGINT AS a, greatest(x1, x2)::BIGINT AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM x
), s AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) r(k))
), freq AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), cand AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k AS size FROM freq WHERE k > 1
), cuts AS (
  SELECT c.*, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM cand c, range(1, 5) q(j) WHERE j < size
), rated AS (
  SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, n, 1000 * a::HUGEINT * n // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.first JOIN freq y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM cand, range(2, 5) p(n), range(1, 5) q(i) WHERE n < size AND i + n - 1 <= size GROUP BY 1, 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""
