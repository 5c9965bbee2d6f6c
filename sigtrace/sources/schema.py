"""Explicit schemas of the packet tables (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

FIELDS_MAP = T.MapType(T.StringType(), T.StringType(), True)

LAYER = T.StructType(
    [
        T.StructField("protocol_name", T.StringType(), True),
        T.StructField("protocol_display", T.StringType(), True),
        T.StructField("fields", FIELDS_MAP, True),
    ]
)

# One dissected packet before enrichment (what the PDML / JSONL readers produce).
LAYERED_PACKET = T.StructType(
    [
        T.StructField("packet_number", T.LongType(), True),
        T.StructField("timestamp", T.DoubleType(), True),
        T.StructField("timestamp_iso", T.StringType(), True),
        T.StructField("length", T.IntegerType(), True),
        T.StructField("protocol_stack", T.ArrayType(T.StringType(), True), True),
        T.StructField("protocol_layers", T.ArrayType(LAYER, True), True),
        T.StructField("source_ip", T.StringType(), True),
        T.StructField("destination_ip", T.StringType(), True),
        T.StructField("source_port", T.IntegerType(), True),
        T.StructField("destination_port", T.IntegerType(), True),
    ]
)

# A JSONL record as the reference writes it: layered packet + enrichment + flat fields.
JSONL_RECORD = T.StructType(
    # timestamp kept as text here: unparsable values become NULL in normalisation
    # instead of turning the whole line into a reject
    [f if f.name != "timestamp" else T.StructField("timestamp", T.StringType(), True) for f in LAYERED_PACKET.fields]
    + [
        T.StructField("ue_id", T.StringType(), True),
        T.StructField("message_type", T.StringType(), True),
        T.StructField("protocol", T.StringType(), True),
        T.StructField("interface", T.StringType(), True),
        T.StructField("direction", T.StringType(), True),
        T.StructField("protocol_fields", FIELDS_MAP, True),
        T.StructField("_corrupt", T.StringType(), True),
    ]
)

# Hot identifiers materialised as plain columns at write time so filters on them
# reach the Parquet scan (a predicate on a map key cannot be pushed down).
HOT_KEYS = {
    "ran_ue_ngap_id": "ngap.ngap.RAN_UE_NGAP_ID",
    "amf_ue_ngap_id": "ngap.ngap.AMF_UE_NGAP_ID",
    "enb_ue_s1ap_id": "s1ap.s1ap.ENB_UE_S1AP_ID",
    "mme_ue_s1ap_id": "s1ap.s1ap.MME_UE_S1AP_ID",
    "rlc_ueid": "rlc_lte.rlc-lte.ueid",
    "ngap_procedure_code": "ngap.ngap.procedureCode",
}

# Identifiers that are stored under several spellings: one column each holds the value that a packet has under any of
# them, so a lookup by any spelling reaches the scan.  Where the spellings of some identifier hold different values in one
# packet, ``hot_ids_differ`` is true and the columns say nothing about that packet.
HOT_ALIASES = {
    "hot_ran": ["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID", "RAN_UE_NGAP_ID"],
    "hot_amf": ["ngap.AMF_UE_NGAP_ID", "ngap.ngap.AMF_UE_NGAP_ID", "AMF_UE_NGAP_ID"],
    "hot_enb": ["s1ap.s1ap.ENB_UE_S1AP_ID"],
    "hot_mme": ["s1ap.s1ap.MME_UE_S1AP_ID"],
    "hot_rlc": ["rlc_lte.rlc-lte.ueid"],
    "hot_m_tmsi": ["s1ap.nas-eps.emm.m_tmsi", "nas_eps.nas-eps.emm.m_tmsi", "rlc_lte.nas-eps.emm.m_tmsi"],
    "hot_imsi": ["s1ap.nas-eps.emm.imsi", "nas_eps.nas-eps.emm.imsi"],
}
HOT_DIFFER = "hot_ids_differ"
