"""SQL of the collocation query."""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0
), grams AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts
), counted AS (
  SELECT lang, list_slice(w, i, i + k - 1) AS words, k, count(*) AS a FROM grams GROUP BY 1, 2, 3
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), often AS (
  SELECT lang, words, k, a, array_to_string(words, ' ') AS phrase FROM counted WHERE a >= 100
), lefts AS (
  SELECT lang, words[2:] AS words, max(a) AS left_most FROM often WHERE k >= 3 GROUP BY 1, 2
), rights AS (
  SELECT lang, words[1:k - 1] AS words, max(a) AS right_most FROM often WHERE k >= 3 GROUP BY 1, 2
), kept AS (
  SELECT o.*, coalesce(left_most, 0) AS left_most, coalesce(right_most, 0) AS right_most
  FROM often o LEFT JOIN lefts USING (lang, words) LEFT JOIN rights USING (lang, words)
  WHERE k >= 2 AND NOT EXISTS (
    SELECT 1 FROM often q WHERE q.lang = o.lang AND q.k > o.k AND 100 * q.a >= 100 * o.a AND contains(' ' || q.phrase || ' ', ' ' || o.phrase || ' '))
), cuts AS (
  SELECT *, unnest(range(1, k)) AS cut FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, f.a AS l, s.a AS r, n, c.left_most, c.right_most,
    (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(f.a AS HUGEINT) * s.a) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN often f ON f.lang = c.lang AND f.words = c.words[1:cut] JOIN often s ON s.lang = c.lang AND s.words = c.words[cut + 1:]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score,
  left_most, right_most
FROM best QUALIFY rank <= 2000
"""
