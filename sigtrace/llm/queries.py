"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.token_counts import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back (U+2581 counts as a space)."""
    from sigtrace.llm.sentencepiece_codec import decode, encode

    plain = F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(plain.cast("binary")).alias("text_crc32"))
    coded = encode(docs, keep=("doc_id", "text_crc32"))
    back = decode(coded, keep=("doc_id", "ids", "n_tokens", "text_crc32"))
    return back.select("doc_id", "n_tokens", "ids", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


@query
def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.line_rules import judge

    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def _line_rules_sql() -> str:
    from sigtrace.llm.line_rules_sql import SQL

    return SQL


ORACLES["op8_line_rules"] = _line_rules_sql()


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.kneser_ney import classify

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted).drop("text_hash")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learnt from rows whose remainder of crc32(doc_id) by 5 is not 0."""
    from sigtrace.llm.toxicity import score

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").where(fold != 0)
    scored = score(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.style_tree import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


ORACLES["op4_topk_search"] = """
WITH ints AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: floor(256 * x::double))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM ints q JOIN ints c ON q.vec_id != c.vec_id AND q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from rows whose remainder of crc32(doc_id) by 7 is not 2."""
    from sigtrace.llm.katz import train

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = train(docs.where("NOT held_out"))
    scored = model.score(docs, keep=("doc_id", "held_out"), learned=~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _made_periodic(doc_id, words: list[bytes]) -> list[bytes]:
    """For ids whose crc32 is divisible by 10, the words from some place on repeat a shorter stretch."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.periodic_runs import periodic_runs

    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=_made_periodic)
    # exact comparison of length / period; ties by start, then period
    steepest = """array_sort(runs, (l, r) -> CASE WHEN l.length * r.period != r.length * l.period THEN IF(l.length * r.period > r.length * l.period, -1, 1)
        WHEN l.start != r.start THEN IF(l.start < r.start, -1, 1) WHEN l.period != r.period THEN IF(l.period < r.period, -1, 1) ELSE 0 END)"""
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.expr(steepest), F.lit(0)).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigtrace.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def _phrases_sql() -> str:
    from sigtrace.llm.phrases_sql import SQL

    return SQL


ORACLES["op13_phrase_collocations"] = _phrases_sql()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
