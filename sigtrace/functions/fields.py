"""Column expressions over the semi-structured ``protocol_fields`` map.

``m`` is ``from_json(protocol_fields_json, 'map<string,string>')``: parsed once per
query, keys keep JSON order, so "first key matching p" is
``get(filter(map_keys(m), p), 0)``.  Everything here is a JVM expression that stays
inside whole-stage codegen; nothing calls back into Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_TYPE = "map<string,string>"


def parse_fields(col: str | Column = "protocol_fields_json") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, MAP_TYPE)


def with_fields(df: DataFrame, name: str = "m") -> DataFrame:
    """Add the parsed map column ``m`` (no-op when already present).

    The map is produced by a one-element ``explode`` (a Generate node) rather than a
    plain projection.  Catalyst pushes filters through projections by inlining the
    aliased expression, which would re-parse the JSON once per reference inside the
    predicate; a filter on a generator output cannot move below the Generate, so the
    JSON is parsed exactly once per row, while filters on plain columns (protocol,
    message_type, ...) still reach the Parquet scan as pushed filters.
    """
    if name in df.columns:
        return df
    if "fields" in df.columns and df.schema["fields"].dataType.simpleString() == MAP_TYPE:
        return df.withColumn(name, F.col("fields"))  # table written by write_packets: already parsed
    return df.select("*", F.explode(F.array(parse_fields())).alias(name))


def val(m: Column, key: str) -> Column:
    """``m[key]``; NULL when missing (map lookup never fails, even under ANSI)."""
    return m.getItem(key)


def truthy(c: Column) -> Column:
    """Python truthiness of a string value: missing and '' are both false."""
    return F.nullif(c, F.lit(""))


def first_of(m: Column, keys: Sequence[str]) -> Column:
    """``d.get(k1) or d.get(k2) or ...``: first non-empty value over key aliases."""
    return F.coalesce(*[truthy(val(m, k)) for k in keys])


def keys_where(m: Column, pred: Callable[[Column], Column]) -> Column:
    return F.filter(F.map_keys(m), pred)


def first_key(m: Column, pred: Callable[[Column], Column]) -> Column:
    """First key (JSON order) satisfying ``pred``; NULL when none."""
    return F.get(keys_where(m, pred), 0)


def first_entry_where(m: Column, pred: Callable[[Column, Column], Column]) -> Column:
    """First ``struct(key, value)`` (JSON order) satisfying ``pred(key, value)``."""
    return F.get(F.filter(F.map_entries(m), lambda e: pred(e["key"], e["value"])), 0)


def has_key(m: Column, pred: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(F.map_keys(m), pred), F.lit(False))


# ---------------------------------------------------------------------------
# Key aliases used by several operators (fixed values: the stored key spellings).
# ---------------------------------------------------------------------------
RAN_KEYS = ["ngap.ngap.RAN_UE_NGAP_ID", "RAN_UE_NGAP_ID", "ngap.RAN_UE_NGAP_ID"]
AMF_KEYS = ["ngap.ngap.AMF_UE_NGAP_ID", "AMF_UE_NGAP_ID", "ngap.AMF_UE_NGAP_ID"]
NGAP_PROC_KEYS = ["ngap.ngap.procedureCode", "procedureCode", "ngap.procedureCode"]
ENB_KEYS = ["s1ap.s1ap.ENB_UE_S1AP_ID", "s1ap.ENB_UE_S1AP_ID", "ENB_UE_S1AP_ID"]
MME_KEYS = ["s1ap.s1ap.MME_UE_S1AP_ID", "s1ap.MME_UE_S1AP_ID", "MME_UE_S1AP_ID"]
RLC_KEYS = ["rlc_lte.rlc-lte.ueid", "rlc_lte.pdcp-lte.ueid"]
M_TMSI_KEYS = ["nas_eps.nas-eps.emm.m_tmsi", "s1ap.nas-eps.emm.m_tmsi", "rlc_lte.nas-eps.emm.m_tmsi", "nas_eps.3gpp.tmsi"]
GUTI_KEYS = ["nas_eps.nas-eps.emm.guti", "s1ap.nas-eps.emm.guti"]
IMSI_KEYS = ["e212.imsi", "nas_eps.e212.imsi", "s1ap.e212.imsi"]


def capture_scope(df) -> list[str]:
    """The capture column where the table has one: UE ids are counters of their network, so those of two captures are different UEs."""
    return ["capture"] if "capture" in df.columns else []


def packet_key(df) -> list[str]:
    """Columns that identify a packet: its number, which restarts in every capture, and the capture where the table has one."""
    return [*capture_scope(df), "packet_number"]
