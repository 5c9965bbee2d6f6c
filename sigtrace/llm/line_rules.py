"""Line-first quality rules, with DataFrame functions only.

Every line with a word is judged by itself:

* navigation: two or more ``|``, at least one per ``NAV_WORDS`` words;
* symbols: symbols ``#*$%&|<>`` number at least ``SYMBOL_SHARE`` % of the words;
* punctuation: exclamation marks number at least half of the words of a line of three or more words;
* heading: fewer than ``MIN_LINE_WORDS`` words and no closing punctuation;
* boilerplate: a stock phrase in a line of at most ``PHRASE_WORDS`` words.

(Here a line's words are its spaces plus one.)  Lines that fail are removed; a document
whose removed lines hold more than ``max_lost`` % of its characters in judged lines is
rejected, as is one that fails the base rules (fewer than 50 words, or more than half of the
words inside 3-word windows found twice or more).

Everything is computed inside the row: no shuffle, no group.  Windows are compared by the
64-bit hash of their three words.

Cases: a null text counts as empty; an empty text has no words, so it fails the base rules;
repeated rows each get a row; very long texts are worked on whole; an empty table gives an
empty result.  Other columns are passed on; own columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space, symbols, smallest document, largest share of repeated words (%).
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50

NAV_WORDS = 6
SYMBOL_SHARE = 40
MIN_LINE_WORDS = 4
PHRASE_WORDS = 30
MAX_LOST = 50
CLOSING = "[.!?:;…»\"')\\]0-9]$"
PHRASES = "(?i)(cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|sign in|log in|subscribe|lorem ipsum|click here)"

OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "line_chars", "kept", "clean_text")


def _count(text, chars: str):
    """How many of ``chars`` are in ``text``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _line_fails(line, symbols, bangs):
    words = _count(line, " ") + 1
    has = lambda c: F.contains(line, F.lit(c))
    bars = F.when(symbols & has("|"), _count(line, "|")).otherwise(0)
    marks = F.when(symbols, _count(line, SYMBOLS)).otherwise(0)
    shouts = F.when(bangs & has("!"), _count(line, "!")).otherwise(0)
    return (
        ((bars >= 2) & (bars * NAV_WORDS >= words))
        | (marks * 100 >= words * SYMBOL_SHARE)
        | ((words >= 3) & (shouts * 2 >= words))
        | ((words < MIN_LINE_WORDS) & ~F.rtrim(line, F.lit(SPACE)).rlike(CLOSING))
        | ((words <= PHRASE_WORDS) & line.rlike(PHRASES))
    )


def judge(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with the columns of ``OWN``; ``clean_text`` is the text without failed lines."""
    at = lambda a, i: F.element_at(a, i + 1)
    none = F.array().cast("array<string>")
    names = {f"own{i}": c for i, c in enumerate(c for c in docs.columns if c not in OWN)}  # no clash with the columns made here
    own = list(names)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.select(*[F.col(c).alias(n) for n, c in names.items()], whole.alias("_t"), F.trim(whole, F.lit(SPACE)).alias("_body"))
    step = step.select(
        *own, "_t",
        F.when(F.col("_body") == "", none).otherwise(F.split("_body", "[\\x20\\x09-\\x0D]+")).alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("_lines"),
        _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
    )
    n = F.size("_words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(F.col("_words"), i), at(F.col("_words"), i + 1), at(F.col("_words"), i + 2)))
    )
    step = step.withColumn("n_words", n.cast("long")).withColumn("_win", windows)
    # windows in order of hash: equal neighbours are windows found twice or more
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    ordered = F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.withColumn("_ord", ordered).drop("_words", "_win")
    o, m = F.col("_ord"), F.size("_ord")
    twin = lambda p, k: ((k > 0) & (at(o, F.greatest(k - 1, F.lit(0)))["h"] == p["h"])) | ((k < m - 1) & (at(o, F.least(k + 1, m - 1))["h"] == p["h"]))
    starts = F.sort_array(F.transform(F.filter(o, twin), lambda p: p["i"]))
    step = step.withColumn("_starts", starts).drop("_ord")
    s, m = F.col("_starts"), F.size("_starts")
    covered = F.when(m == 0, F.lit(0)).otherwise(
        F.aggregate(F.zip_with(F.slice(s, F.lit(2), m), F.slice(s, F.lit(1), F.greatest(m - 1, F.lit(0))), lambda b, a: F.least(F.lit(3), b - a)), F.lit(3), lambda x, y: x + y)
    )
    symbols, bangs = F.col("n_symbols") > 0, F.contains(F.col("_t"), F.lit("!"))
    step = step.select(
        *own, "_t", "_lines", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.filter("_lines", lambda x: _line_fails(x, symbols, bangs)).alias("_failed"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    step = step.withColumns({
        "base_failed": base,
        "lost_chars": F.length(F.array_join("_failed", "")).cast("long"),
        "line_chars": F.length(F.array_join("_lines", "")).cast("long"),
    })
    # the row number is never negative; it keeps a filter on the verdict above these projections,
    # where pushing it down would copy all their expressions into it
    kept = (F.monotonically_increasing_id() >= 0) & ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("line_chars") * max_lost)
    clean = F.when(F.size("_failed") == 0, F.col("_t")).otherwise(F.array_join(F.filter(F.split("_t", "\n"), lambda x: ~_line_fails(x, symbols, bangs) | (F.trim(x, F.lit(SPACE)) == "")), "\n"))
    return step.withColumns({"kept": kept, "clean_text": clean}).drop("_t", "_lines", "_failed").withColumnsRenamed(names)
