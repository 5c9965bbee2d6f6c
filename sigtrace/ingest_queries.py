"""Registered round trips for ingest (A) and enrichment (B).

The driver ships no capture files, so these builders derive captures from the
``packets`` projection of ``events`` *with Spark*: dissected layers are rebuilt
from the flat field map, written as JSONL or PDML into the shared checkpoint
folder, and read back through the real readers.  The work therefore grows with
the input tables, and the core columns can be checked against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.operators import enrich as B
from sigtrace.registry import register, register_raw
from sigtrace.session import scratch_path
from sigtrace.sources import packets as S
from sigtrace.sources.events_projection import packets_from_events
from sigtrace.sources.ingest import ingest_run
from sigtrace.sources.pdml import read_pdml, to_pdml_records
from sigtrace.oracle import ingest_sql as IS

CORE = ["packet_number", "timestamp", "timestamp_iso", "length", "source_ip", "destination_ip"]


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.enrich_packets(B.layers_from_fields(packets_from_events(spark, sf_dir)))


def _jsonl_capture(spark: SparkSession, sf_dir: str) -> str:
    rec = _enriched(spark, sf_dir)
    path = scratch_path(spark, "capture-jsonl")
    rec.select(F.to_json(F.struct(*rec.columns)).alias("value")).write.text(path)
    return path


def _pdml_capture(spark: SparkSession, sf_dir: str) -> str:
    layered = B.layers_from_fields(packets_from_events(spark, sf_dir))
    path = scratch_path(spark, "capture-pdml")
    to_pdml_records(layered).write.text(path)
    return path


@register_raw("ingest_jsonl", IS.ingest_jsonl)
def ingest_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: JSONL capture -> packets (core columns, field count, RAN id)."""
    good, _ = S.read_jsonl(spark, _jsonl_capture(spark, sf_dir))
    f = F.col("protocol_fields")
    core = [F.col(c).try_cast("double").alias(c) if c == "timestamp" else F.col(c) for c in CORE]
    return good.select(*core, F.size(f).alias("n_fields"), f["ngap.ngap.RAN_UE_NGAP_ID"].alias("ran_ue_id"))


@register_raw("ingest_pdml", IS.ingest_pdml)
def ingest_pdml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2: PDML capture -> packets -> enrichment (frame layer adds three fields)."""
    good, _ = read_pdml(spark, _pdml_capture(spark, sf_dir))
    flat = B.flatten_fields()
    return good.select(
        "packet_number", "timestamp", "length", F.size(flat).alias("n_fields"),
        flat["ngap.ngap.RAN_UE_NGAP_ID"].alias("ran_ue_id"), flat["s1ap.s1ap.ENB_UE_S1AP_ID"].alias("enb_ue_id"),
    )


@register_raw("pdml_field_context", IS.pdml_field_context)
def pdml_field_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: measurement keys seen after the PDML round trip (rows-only check)."""
    good, _ = read_pdml(spark, _pdml_capture(spark, sf_dir))
    flat = B.flatten_fields()
    return good.select("packet_number", F.explode(F.filter(F.map_keys(flat), lambda k: k.contains("Result"))).alias("field"))


@register_raw("normalize_packets", IS.normalize_packets)
def normalize_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: normalised packets table (time columns and hot id columns)."""
    n = S.normalize_packets(_enriched(spark, sf_dir))
    return n.select(
        "packet_number", "timestamp", F.date_format("timestamp_hour", "yyyy-MM-dd HH:mm:ss").alias("hour"),
        "ran_ue_ngap_id", "amf_ue_ngap_id", "enb_ue_s1ap_id", "rlc_ueid",
    )


@register_raw("load_packets", IS.load_packets)
def load_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A6: write the normalised table (date-partitioned Parquet), load it back."""
    path = scratch_path(spark, "packets")
    S.write_packets(S.normalize_packets(_enriched(spark, sf_dir)), path)
    p = S.load_packets(spark, [path])
    return p.select("packet_number", "timestamp", F.col("capture_date").cast("string").alias("capture_date"), "ran_ue_ngap_id", "enb_ue_s1ap_id")


@register_raw("write_packets", IS.write_packets)
def write_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + C3: what the sink's partitions hold, day by day, and that every row is in some file."""
    from sigtrace.operators.catalog import dataset_stats

    path = scratch_path(spark, "packets")
    S.write_packets(S.normalize_packets(_enriched(spark, sf_dir).withColumn("capture", F.lit("events"))), path)
    table = spark.read.parquet(path)
    stored = dataset_stats(table).agg(F.sum("rows").alias("n")).scalar()
    days = table.groupBy(F.col("capture_date").cast("string").alias("capture_date"), "capture").agg(
        F.count(F.lit(1)).alias("rows"), F.min("packet_number").alias("first_packet"), F.max("packet_number").alias("last_packet")
    )
    return days.select("*", stored.alias("rows_in_files"))


@register_raw("dataset_stats", IS.dataset_stats)
def dataset_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 over the driver's events file: rows and columns, and that every file's bytes are known."""
    from sigtrace.operators.catalog import dataset_stats

    stats = dataset_stats(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"))
    return stats.agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), (F.min("file_size") > 0).alias("sized"))


@register("filter_by_protocol_stack", IS.filter_by_protocol_stack)
def filter_by_protocol_stack(p: DataFrame) -> DataFrame:
    """Packets whose (derived) protocol stack holds one of the default protocols."""
    layered = S.filter_by_protocol_stack(B.layers_from_fields(p))
    return layered.select("packet_number", F.array_join("protocol_stack", ",").alias("stack"))


@register_raw("ingest_stream", IS.ingest_stream)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the JSONL capture into Parquet with availableNow, then read the table."""
    from sigtrace.streaming.ingest import ingest_stream as start

    src = _jsonl_capture(spark, sf_dir)
    out = scratch_path(spark, "stream-out")
    q = start(spark, src, out, fmt="jsonl", checkpoint_path=scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    return spark.read.parquet(out).select("packet_number", "timestamp", "ran_ue_ngap_id")


@register_raw("write_results", IS.write_results)
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a result as CSV (header, NULL as empty) and read it back."""
    from sigtrace.operators.release import release_events

    path = scratch_path(spark, "results-csv")
    S.write_results(release_events(packets_from_events(spark, sf_dir)).drop("normal"), path, fmt="csv")
    return spark.read.option("header", True).csv(path)


@register_raw("parse_run_summary", IS.parse_run_summary)
def parse_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: one parse of a JSONL capture with a cut-off line after every 97th packet, both sinks, and what it reports."""
    rec = _enriched(spark, sf_dir)
    line = F.to_json(F.struct(*rec.columns))
    cut = F.when(F.col("packet_number") % 97 == 0, F.array(line, F.substring(line, 1, 40))).otherwise(F.array(line))
    source, path = scratch_path(spark, "capture-jsonl"), scratch_path(spark, "packets")
    rec.select(F.explode(cut).alias("value")).write.text(source)
    said = ingest_run(spark, source, path, fmt="jsonl", capture="events")
    stored = S.load_packets(spark, path).groupBy("capture").agg(F.count(F.lit(1)).alias("stored"))
    malformed = spark.read.parquet(path + "_rejects").agg(F.count(F.lit(1)).alias("n")).scalar()
    return stored.select("capture", "stored", malformed.alias("rejected"), F.lit(said["packets"]).cast("long").alias("packets"), F.lit(said["malformed"]).cast("long").alias("malformed"), F.lit(said["output_bytes"] > 0).alias("written"))


# --- B: enrichment ------------------------------------------------------------------
@register("decode_procedure", IS.decode_procedure)
def decode_procedure(p: DataFrame) -> DataFrame:
    """B1: procedure code -> name for S1AP and NGAP packets."""
    from sigtrace.functions.fields import with_fields

    d = with_fields(p)
    m = F.col("m")
    s1, ng = m["s1ap.s1ap.procedureCode"], m["ngap.ngap.procedureCode"]
    return d.where(s1.isNotNull() | ng.isNotNull()).select(
        "packet_number",
        F.when(s1.isNotNull(), "S1AP").otherwise("NGAP").alias("family"),
        F.coalesce(s1, ng).alias("code"),
        F.when(s1.isNotNull(), B.decode_procedure("S1AP", s1)).otherwise(B.decode_procedure("NGAP", ng)).alias("name"),
    )


@register("decode_nas_5gs", IS.decode_nas_5gs)
def decode_nas_5gs(p: DataFrame) -> DataFrame:
    """B2: NAS-5GS message code (hex or decimal) -> name."""
    from sigtrace.functions.fields import with_fields

    d = with_fields(p)
    mm = d["m"]["ngap.nas-5gs.mm.message_type"]
    return d.where(mm.isNotNull()).select(
        "packet_number", mm.alias("raw_code"), B.nas_code(mm).alias("code"), B.decode_nas_5gs(mm).alias("name")
    )


@register("flatten_fields", IS.flatten_fields)
def flatten_fields(p: DataFrame) -> DataFrame:
    """Re-flattened layer fields equal the original map (size, first key, an id)."""
    layered = B.layers_from_fields(p)
    flat = B.flatten_fields()
    return layered.select(
        "packet_number", F.size(flat).alias("n_fields"), F.get(F.map_keys(flat), 0).alias("first_key"),
        flat["ngap.ngap.RAN_UE_NGAP_ID"].alias("ran_ue_id"),
    )


@register("enrich_packets", IS.enrich_packets)
def enrich_packets(p: DataFrame) -> DataFrame:
    """Derived ue_id, message_type, protocol, interface, direction (rows-only check)."""
    e = B.enrich_packets(B.layers_from_fields(p))
    return e.select("packet_number", "ue_id", "message_type", "protocol", "interface", "direction")


@register("protocol_layer", IS.protocol_layer)
def protocol_layer(p: DataFrame) -> DataFrame:
    """NGAP layer lookup and SCTP membership per packet (rows-only check)."""
    layered = B.layers_from_fields(p)
    return layered.select(
        "packet_number",
        F.size(B.protocol_layer("NGAP")["fields"]).cast("double").alias("ngap_fields"),  # NULL without an NGAP layer
        B.has_protocol("sctp").alias("has_sctp"),
        B.layer_field("ngap", "ngap.procedureCode", "-").alias("procedure_code"),
    )


def _enriched_cols(p: DataFrame, *cols: str) -> DataFrame:
    e = B.enrich_packets(B.layers_from_fields(p))
    return e.select("packet_number", *cols)


register("extract_ue_id", IS.extract_ue_id)(lambda p: _enriched_cols(p, "ue_id"))
register("extract_message_type", IS.extract_message_type)(lambda p: _enriched_cols(p, "message_type"))
register("extract_protocol", IS.extract_protocol)(lambda p: _enriched_cols(p, "protocol"))
register("extract_interface", IS.extract_interface)(lambda p: _enriched_cols(p, "interface"))
register("extract_direction", IS.extract_direction)(lambda p: _enriched_cols(p, "direction"))
