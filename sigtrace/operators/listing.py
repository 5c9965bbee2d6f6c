"""Canned aggregations and listings.

Whole-table forms of the reference's example queries: no row caps (a ``limit``
argument exists only for callers that want a preview).  Grouped counts use
partial aggregation; listings are filters that push down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.functions.fields import has_key, with_fields
from sigtrace.operators.predicates import RRC_MOBILITY_MESSAGES


def _cap(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def unique_ue_count(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct non-null ``ue_id`` (exact, or HyperLogLog++ when asked)."""
    agg = F.approx_count_distinct("ue_id") if approximate else F.countDistinct("ue_id")
    return packets.where(F.col("ue_id").isNotNull()).agg(agg.alias("unique_ues"))


def ue_list(packets: DataFrame) -> DataFrame:
    """Distinct UE ids."""
    return packets.where(F.col("ue_id").isNotNull()).select("ue_id").distinct()


def ue_summary(packets: DataFrame) -> DataFrame:
    """Per UE first / last packet, packets, and its message types.

    The type list is built from distinct (UE, type) pairs first, so each list is
    bounded by the protocol vocabulary, not by the UE's packet count.
    """
    ue = packets.where(F.col("ue_id").isNotNull())
    per_type = ue.groupBy("ue_id", "message_type").agg(
        F.min("packet_number").alias("first_packet"),
        F.max("packet_number").alias("last_packet"),
        F.count(F.lit(1)).alias("packets"),
    )
    return per_type.groupBy("ue_id").agg(
        F.min("first_packet").alias("first_packet"),
        F.max("last_packet").alias("last_packet"),
        F.sum("packets").cast("bigint").alias("packets"),
        F.array_join(F.array_sort(F.collect_list("message_type")), ",").alias("message_types"),
    )


def _count_by(packets: DataFrame, col: str) -> DataFrame:
    return packets.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def count_by_protocol(packets: DataFrame) -> DataFrame:
    """Packets per protocol."""
    return _count_by(packets, "protocol")


def packets_per_hour(packets: DataFrame) -> DataFrame:
    """E5: packets per hour (hour rendered as text, UTC)."""
    return packets.groupBy(F.date_format("timestamp_hour", "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(
        F.count(F.lit(1)).alias("packet_count")
    )


def count_by_direction(packets: DataFrame) -> DataFrame:
    """Packets per direction."""
    return _count_by(packets, "direction")


def count_by_interface(packets: DataFrame) -> DataFrame:
    """Packets per interface (the distinct interfaces are its keys)."""
    return _count_by(packets, "interface")


def handover_outcome_counts(packets: DataFrame) -> DataFrame:
    """X2AP handover messages per message type."""
    return (
        packets.where((F.col("protocol") == "X2AP") & F.col("message_type").like("%Handover%"))
        .groupBy("message_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def ue_protocol_breakdown(packets: DataFrame) -> DataFrame:
    """Packets per UE x protocol x message type (all UEs)."""
    return (
        packets.where(F.col("ue_id").isNotNull())
        .groupBy("ue_id", "protocol", "message_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def packet_timeline(packets: DataFrame, limit: int | None = None) -> DataFrame:
    """Packets in time order (global range-partitioned sort)."""
    out = packets.select("packet_number", "timestamp", "protocol", "message_type").orderBy("timestamp", "packet_number")
    return _cap(out, limit)


def attached_ues(packets: DataFrame) -> DataFrame:
    """Packets proving attachment: RRC setup complete, NAS attach accept (66),
    S1AP initial context setup (name or code 9, K12)."""
    df = with_fields(packets)
    rrc = (F.col("message_type") == "rrcConnectionSetupComplete") | has_key(
        F.col("m"), lambda k: k.contains("rrcConnectionSetupComplete")
    )
    nas = (F.col("protocol") == "NAS_EPS") & F.col("message_type").isin("66", "Attach accept")
    s1 = (F.col("protocol") == "S1AP") & F.col("message_type").isin("InitialContextSetup", "9")
    return df.where(F.coalesce(rrc | nas | s1, F.lit(False))).select(
        "packet_number", "timestamp_iso", "ue_id", "protocol", "message_type"
    ).distinct()


def handover_messages(packets: DataFrame) -> DataFrame:
    """S1AP/X2AP handover messages and RRC mobility messages, tagged by scope.

    ``scope`` is X2 / S1 / RRC; ``is_failure`` marks messages whose type mentions Failure.
    """
    ho_type = F.col("message_type").like("%andover%") | F.col("message_type").like("%HO%")
    cond = (F.col("protocol").isin("S1AP", "X2AP") & ho_type) | (
        (F.col("protocol") == "RRC") & F.col("message_type").isin(RRC_MOBILITY_MESSAGES)
    )
    scope = F.when(F.col("protocol") == "X2AP", "X2").when(F.col("protocol") == "S1AP", "S1").otherwise("RRC")
    return packets.where(cond).select(
        "packet_number",
        "timestamp_iso",
        "protocol",
        "message_type",
        "direction",
        scope.alias("scope"),
        F.col("message_type").like("%Failure%").alias("is_failure"),
    )


def measurement_reports(packets: DataFrame) -> DataFrame:
    """RRC measurement reports that carry RSRP or RSRQ fields."""
    df = with_fields(packets)
    has_meas = has_key(F.col("m"), lambda k: k.contains("rsrpResult") | k.contains("rsrqResult"))
    return df.where(
        (F.col("protocol") == "RRC") & (F.col("message_type") == "measurementReport") & has_meas
    ).select("packet_number", "timestamp_iso", "message_type", "protocol_fields_json")
