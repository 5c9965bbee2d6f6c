"""DuckDB text of the phrase query, from the definitions: all phrases are counted, nothing is pruned."""

SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM worded GROUP BY lang),
spans AS (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
  FROM worded, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE len(w) >= k),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::bigint AS f
  FROM spans GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k >= 2),
kept AS (
  SELECT c.* FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d
    WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, w, a, k, unnest(generate_series(1, k - 1)) AS cut FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, cut,
    ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint AS score
  FROM cuts
  JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 : ], ' ')
  JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest WHERE place = 1)
SELECT lang, rank::bigint AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
