"""Continuous ingest of arriving captures with Structured Streaming.

New PDML or JSONL files dropped into a folder are parsed, enriched and appended
to the Parquet ``packets`` table.  The job is stateless (append-only), so the
checkpoint only records which files were processed; ``availableNow`` drains what
is there and stops, ``processingTime`` keeps running.  Each micro-batch writes its
own ``batch_id`` partition with dynamic partition overwrite, so a batch replayed
after a failure replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigtrace.session import ensure_checkpoint_dir
from sigtrace.sources.ingest import good_packets, parsed_records, rejects
from sigtrace.sources.packets import with_capture
from sigtrace.sources.pdml import RECORD_SEPARATOR


def _parsed_stream(spark: SparkSession, source_dir: str, fmt: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "pdml":
        reader = reader.option("lineSep", RECORD_SEPARATOR)
    return parsed_records(with_capture(reader.text(source_dir)), fmt)


def ingest_stream(
    spark: SparkSession,
    source_dir: str,
    output_path: str,
    fmt: str = "pdml",
    checkpoint_path: str | None = None,
    rejects_path: str | None = None,
    available_now: bool = True,
    processing_time: str = "30 seconds",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the ingest stream; returns the running query (``awaitTermination()`` to wait)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # the same path in every process, so a restarted stream goes on where it stopped
    name = hashlib.sha256(f"{source_dir}\n{output_path}".encode()).hexdigest()[:16]
    checkpoint_path = checkpoint_path or f"{base}/streams/ingest-{name}"
    rejects_path = rejects_path or output_path.rstrip("/") + "_rejects"
    parsed = _parsed_stream(spark, source_dir, fmt, max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # two sinks per micro-batch: persist so the parse runs once (the documented
        # foreachBatch idiom); a lost executor just recomputes the batch from its files
        batch = batch.persist()
        try:
            _write(batch, batch_id)
        finally:
            batch.unpersist()

    def _write(batch: DataFrame, batch_id: int) -> None:
        for rows, path in ((good_packets(batch, fmt), output_path), (rejects(batch, fmt), rejects_path)):
            rows = rows.withColumn("batch_id", F.lit(batch_id))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    writer = parsed.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
