"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``.  ``run`` applies them to
``documents``, writing and rereading each result as Parquet in the shared folder.

Cases (of every stage): null ids, languages and texts, empty and very long texts, ties and
empty tables are handled as the stage's operator says; extra columns pass through.  A null or
empty text is kept by the quality classifier (its perplexity is the trusted texts' own) and rejected by the
quality rules.  Repeated rows stay until the join stage, which keeps one row of each group of
near duplicates (the smallest id, of rows with that id one text), one row of each id and text
without words, and every row without an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.llm.common import table, written
from sigtrace.llm.jaccard_join import near_duplicates
from sigtrace.llm.kneser_ney import classify, text_hash
from sigtrace.llm.line_rules import judge
from sigtrace.llm.packing import pack
from sigtrace.llm.pii import find
from sigtrace.session import configure


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named so that no operator's own columns clash, and those names by the old ones."""
    names = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _with_text(changed: DataFrame, names: dict[str, str], text) -> DataFrame:
    """The columns ``names`` of ``_plain`` with another text, and its length where the table has one."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return changed.select(*[(new[c] if c in new else F.col(n)).alias(c) for c, n in names.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted texts does not reject."""
    configure(spark)
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = classify(docs, trusted)
    # a decision depends on text and language; a written table's size is known, so Spark broadcasts it only if small
    rejected = written(judged.where(~F.col("kept")).select(F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang")).distinct(), "pipeline-rejected")
    same = (text_hash(docs["text"]) == rejected["_hash"]) & docs["lang"].cast("string").eqNullSafe(rejected["_lang"])
    return docs.join(rejected, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their lines, without the lines that failed."""
    configure(spark)
    plain, names = _plain(docs)
    return _with_text(judge(plain, text=names["text"]).where("kept"), names, F.col("clean_text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    configure(spark)
    found = near_duplicates(docs, grouped=True).where("doc_id IS NOT NULL")
    own = F.struct(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    grouped = found.where("group IS NOT NULL").groupBy("group").agg(F.min(own).alias("own")).select("own.*")
    first = written(grouped.unionByName(found.where("group IS NULL").select(own.alias("own")).select("own.*")).distinct(), "pipeline-first")
    plain, names = _plain(docs)
    key = [names["doc_id"], "_hash"]
    hashed = plain.withColumn("_hash", text_hash(F.col(names["text"]))).join(first.withColumnRenamed("_id", names["doc_id"]), key, "left_semi")
    named = hashed.dropDuplicates(key).select(*[F.col(n).alias(c) for c, n in names.items()])
    return named.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    configure(spark)
    plain, names = _plain(docs)
    others = tuple(n for c, n in names.items() if c != "text")
    found = find(plain, text=names["text"], keep=others, redacted=True)
    return _with_text(found, names, F.col("redacted"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    configure(spark)
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the language model, the tagger and the tokenizer: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
