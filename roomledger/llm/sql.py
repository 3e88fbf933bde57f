"""DuckDB SQL of the operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (
  SELECT lang, size, w[i : i + size - 1] AS g, count(*) AS f
  FROM starts, (VALUES (1), (2), (3)) AS sizes(size) WHERE i + size - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 10),
named AS (SELECT lang, size, g, array_to_string(g, ' ') AS phrase, f FROM grams),
around AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase, f FROM named WHERE size = 3)
  GROUP BY lang, phrase),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.g[1:k], ' ') AS first, array_to_string(c.g[k + 1:], ' ') AS rest
  FROM named c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase, (VALUES (1), (2)) AS ks(k)
  WHERE c.size > 1 AND k < c.size AND (o.longer IS NULL OR 100 * o.longer < 50 * c.f)),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.k, p.f AS l, q.f AS r,
    ((1000000::HUGEINT * x.a * x.a) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts x JOIN named p ON p.lang = x.lang AND p.phrase = x.first JOIN named q ON q.lang = x.lang AND q.phrase = x.rest),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

JACCARD = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM starts),
sizes AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, n::BIGINT AS n_shingles, min(other) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
