"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(6000)) + "."
PLAIN = "The quick brown fox jumps over the lazy dog near the quiet river bank while seven small birds sing about the morning sun. " * 3
TEXTS = [
    (1, PLAIN, "en", "s", 1), (1, PLAIN, "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0), (None, PLAIN + " more words here.", "en", "s", 5),
    (4, "   \n\t ", "de", "s", 6), (5, LONG, "en", "s", len(LONG)), (6, LONG + " One more end.", "en", "s", 7), (7, "a\x00b ▁ \U0001f600 é日本 <s></s> <|endoftext|>  two", "fr", "s", 3),
    (8, "Write to ann.lee+x@mail.example.org or call +1 (555) 010-9999 now, card 4111 1111 1111 1111 at 10.0.0.255 or 300.1.1.1.", "en", "s", 4),
    (9, "home | news | sport | login\n" * 20, "en", "s", 4), (10, PLAIN, None, "t", 4), (11, "one two three", "en", "s", 3), (12, "ONE  two\nthree", "en", "s", 3), (13, "one two three four", "en", "s", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """With extra columns named like internal ones."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(TEXTS, SCHEMA)
    return docs.withColumns({c: F.lit("extra") for c in ("d", "t", "x", "z", "node", "size", "h", "kept", "good", "_t", "_lines", "rank", "length", "task", "k0", "spans")})


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
