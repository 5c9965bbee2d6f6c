"""DuckDB text of the line-first rules over ``documents``."""

from sigtrace.llm import line_rules as R


def _count(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


_WORDS = f"({_count('line', ' ')} + 1)"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
each AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM words),
three AS (SELECT r, i, a, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM each WINDOW s AS (PARTITION BY r ORDER BY i)),
found AS (SELECT r, i, (c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1)::int AS twice FROM three),
cover AS (SELECT r, greatest(twice, coalesce(lag(twice) OVER s, 0), coalesce(lag(twice, 2) OVER s, 0)) AS in_repeat FROM found WINDOW s AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, sum(in_repeat)::bigint AS n_repeat_words FROM cover GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
judged AS (
  SELECT r, line,
    ({_count('line', '|')} >= 2 AND {_count('line', '|')} * {R.NAV_WORDS} >= {_WORDS})
    OR {_count('line', R.SYMBOLS)} * 100 >= {_WORDS} * {R.SYMBOL_SHARE}
    OR ({_WORDS} >= 3 AND {_count('line', '!')} * 2 >= {_WORDS})
    OR ({_WORDS} < {R.MIN_LINE_WORDS} AND NOT regexp_matches(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), '{R.CLOSING.replace("'", "''")}'))
    OR ({_WORDS} <= {R.PHRASE_WORDS} AND regexp_matches(line, '{R.PHRASES}')) AS fails
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line))::bigint AS line_chars,
    coalesce(sum(length(line)) FILTER (fails), 0)::bigint AS lost_chars
  FROM judged GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
    {_count('t', R.SYMBOLS)}::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(lost_chars, 0)::bigint AS lost_chars, coalesce(line_chars, 0)::bigint AS line_chars
  FROM docs JOIN words USING (r) LEFT JOIN by_line USING (r) LEFT JOIN repeats USING (r)),
base AS (SELECT *, n_words < {R.MIN_WORDS} OR 100 * n_repeat_words > {R.MAX_REPEAT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars * 100 <= line_chars * {R.MAX_LOST} AS kept, lost_chars
FROM base
"""
