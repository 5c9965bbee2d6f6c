"""One ingest run: a capture is parsed once, and both sinks and the counters are fed from the parsed rows (A1, A3, A5, A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sigtrace.operators.enrich import enrich_packets
from sigtrace.session import scratch_path
from sigtrace.sources.packets import normalize_packets, parse_jsonl_lines, with_capture, write_packets
from sigtrace.sources.pdml import RECORD_SEPARATOR, parse_pdml_text

#: What a reject keeps, by source format.
REJECT_COLUMNS = {"pdml": ["capture", "_error", "_record"], "jsonl": ["capture", "_corrupt"]}


def parsed_records(text: DataFrame, fmt: str) -> DataFrame:
    """Packets and rejects of text records (``value``, ``capture``) in one table, told apart by ``_ok``."""
    if fmt == "pdml":
        return parse_pdml_text(text).withColumn("_ok", F.col("_error").isNull())
    if fmt == "jsonl":
        return parse_jsonl_lines(text).withColumn("_ok", F.col("_corrupt").isNull())
    raise ValueError(f"unknown capture format: {fmt}")


def good_packets(parsed: DataFrame, fmt: str) -> DataFrame:
    """The ``packets`` table of parsed records: PDML packets are enriched, JSONL ones come enriched."""
    good = parsed.where("_ok").drop("_ok", *[c for c in REJECT_COLUMNS[fmt] if c != "capture"])
    return normalize_packets(enrich_packets(good) if fmt == "pdml" else good)


def rejects(parsed: DataFrame, fmt: str) -> DataFrame:
    return parsed.where(~F.col("_ok")).select(*REJECT_COLUMNS[fmt])


def text_records(spark: SparkSession, source: str | list[str], fmt: str, capture: Column | str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", RECORD_SEPARATOR) if fmt == "pdml" else spark.read
    return with_capture(reader.text(source), capture)


def ingest_run(
    spark: SparkSession, source: str | list[str], path: str, fmt: str = "pdml", capture: Column | str | None = None, rejects_path: str | None = None, partition_by_date: bool = True
) -> dict:
    """Parse ``source`` once, write the packets table and the rejects, and report packets, malformed records and output bytes.

    The parsed rows are staged as Parquet in the shared folder, so the sinks read columns instead of parsing
    again and a lost executor repeats a task, not the parse; the counts are metrics of that one write.
    """
    seen = Observation("parsed")
    counts = [F.count_if("_ok").alias("packets"), F.count_if(~F.col("_ok")).alias("malformed")]
    staged = scratch_path(spark, "parsed")
    parsed_records(text_records(spark, source, fmt, capture), fmt).observe(seen, *counts).write.parquet(staged)
    parsed = spark.read.parquet(staged)
    write_packets(good_packets(parsed, fmt), path, partition_by_date=partition_by_date)
    rejects(parsed, fmt).write.mode("overwrite").parquet(rejects_path or path.rstrip("/") + "_rejects")
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size").alias("b")).first()["b"]
    return {"packets": seen.get["packets"], "malformed": seen.get["malformed"], "output_bytes": int(size or 0)}
