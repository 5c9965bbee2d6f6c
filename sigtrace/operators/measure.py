"""Radio measurement extraction (F1-F5): serving-cell RSRP / RSRQ per report.

F1 is a per-row projection over the field map (no shuffle).  F4 / F5 resolve a
logical UE value to RLC UE ids through three tiers (direct, correlation groups,
same-packet scan), decided per requested value with an aggregated flag joined
back, never with a driver-side count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.functions.fields import capture_scope, packet_key, val, with_fields

# FIXED VALUES: key suffixes and neighbour-list markers of RRC measurement reports.
PCELL_RSRP_SUFFIX = "lte-rrc.rsrpResult__context=pcell"
PCELL_RSRQ_SUFFIX = "lte-rrc.rsrqResult__context=pcell"
NEIGHBOUR_MARKERS = ["measResultNeighCells", "measResultListEUTRA", "cellsTriggeredList", "measResultBestNeighCell"]


def _is_neighbour(k: Column) -> Column:
    out = F.lit(False)
    for mk in NEIGHBOUR_MARKERS:
        out = out | k.contains(mk)
    return out


def _first_int(m: Column, token: str) -> Column:
    """First value (key order) of a non-neighbour key containing ``token`` that parses as int."""
    entries = F.filter(
        F.map_entries(m), lambda e: e["value"].isNotNull() & ~_is_neighbour(e["key"]) & e["key"].contains(token)
    )
    ints = F.filter(F.transform(entries, lambda e: e["value"].try_cast("int")), lambda x: x.isNotNull())
    return F.get(ints, 0)


def serving_cell_values(m: Column) -> tuple[Column, Column]:
    """(rsrp, rsrq) of the serving cell, NULL when the report does not qualify."""
    keys = F.map_keys(m)
    pk_rsrp = F.get(F.filter(keys, lambda k: k.endswith(PCELL_RSRP_SUFFIX)), 0)
    pk_rsrq = F.get(F.filter(keys, lambda k: k.endswith(PCELL_RSRQ_SUFFIX)), 0)
    direct = pk_rsrp.isNotNull() & pk_rsrq.isNotNull()
    has_pcell = F.exists(keys, lambda k: k.endswith("measResultPCell_element"))
    has_neigh = F.exists(keys, _is_neighbour)
    rsrp_fb = _first_int(m, "rsrpResult")
    rsrq_fb = _first_int(m, "rsrqResult")
    fb_ok = has_pcell & ~(has_neigh & (rsrp_fb.isNull() | rsrq_fb.isNull()))
    rsrp = F.when(direct, m[pk_rsrp].try_cast("int")).when(fb_ok, rsrp_fb)
    rsrq = F.when(direct, m[pk_rsrq].try_cast("int")).when(fb_ok, rsrq_fb)
    return rsrp, rsrq


def rsrp_to_dbm(v: Column) -> Column:
    """integer 0..97 -> ``"<v-140>dBm to <v-139>dBm"``; otherwise ``Unknown``."""
    ok = v.isNotNull() & (v >= 0) & (v <= 97)
    return F.when(ok, F.format_string("%ddBm to %ddBm", v - 140, v - 139)).otherwise(F.lit("Unknown"))


def rsrq_to_db(v: Column) -> Column:
    """integer 0..34 -> ``"<v/2-19.5>dB to <v/2-19.0>dB"`` (one decimal); otherwise ``Unknown``."""
    ok = v.isNotNull() & (v >= 0) & (v <= 34)
    lo = F.lit(-19.5) + v.cast("double") * 0.5
    return F.when(ok, F.format_string("%.1fdB to %.1fdB", lo, lo + 0.5)).otherwise(F.lit("Unknown"))


def rsrp_rsrq(packets: DataFrame) -> DataFrame:
    """F1 (+F2, F3): one row per qualifying measurement report with both values."""
    df = with_fields(packets)
    rsrp, rsrq = serving_cell_values(F.col("m"))
    return (
        df.select(*packet_key(df), "timestamp_iso", val(F.col("m"), "rlc_lte.rlc-lte.ueid").alias("rlc_ueid"),
                  rsrp.alias("rsrp_result"), rsrq.alias("rsrq_result"))
        .where(F.col("rsrp_result").isNotNull() & F.col("rsrq_result").isNotNull())
        .select(*packet_key(df), "timestamp_iso", "rlc_ueid", "rsrp_result",
                rsrp_to_dbm(F.col("rsrp_result")).alias("rsrp_dbm"), "rsrq_result",
                rsrq_to_db(F.col("rsrq_result")).alias("rsrq_db"))
    )


def _rsrp_packets(packets: DataFrame) -> DataFrame:
    """Packets having any key mentioning rsrpResult, with their RLC / ENB / MME ids."""
    df = with_fields(packets)
    m = F.col("m")
    return df.where(F.exists(F.map_keys(m), lambda k: k.contains("rsrpResult"))).select(
        *packet_key(df),
        val(m, "rlc_lte.rlc-lte.ueid").alias("rlc"),
        val(m, "s1ap.s1ap.ENB_UE_S1AP_ID").alias("enb"),
        val(m, "s1ap.s1ap.MME_UE_S1AP_ID").alias("mme"),
    )


def resolve_rlc_ids(packets: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """logical UE value (column ``ue_value``) -> RLC UE ids, with the tier that found them.

    Tier 1 (direct): the value is an RLC id that has measurement packets.
    Tier 2 (correlation): RLC ids grouped with an ENB / MME / m_tmsi id equal to the value.
    Tier 3 (same packet, only for values still unresolved): RLC ids on measurement
    packets whose ENB or MME id equals the value.

    In a table of several captures a value is resolved in each capture on its own (rows carry ``capture``); a group
    that spans captures gives a capture's value the RLC ids of that capture.
    """
    scope = capture_scope(packets)
    named = capture_scope(requests) if scope else []  # requests may name their capture
    req = requests.select(*named, F.col("ue_value").cast("string").alias("ue_value")).distinct()
    by = [*named, "ue_value"]
    meas = _rsrp_packets(packets)
    direct = req.join(
        meas.where(F.col("rlc").isNotNull()).select(*scope, F.col("rlc").alias("ue_value")).distinct(), by
    ).select(*scope, "ue_value", F.col("ue_value").alias("rlc_ueid"), F.lit(1).alias("tier"))
    anchors = groups.where(F.col("id_type").isin("enb_ue_s1ap_id", "mme_ue_s1ap_id", "m_tmsi")).select(
        *scope, F.col("value").alias("ue_value"), "ue_group"
    )
    rlc_of_group = groups.where(F.col("id_type") == "rlc_ueid").select(*scope, "ue_group", F.col("value").alias("rlc_ueid"))
    corr = (
        req.join(anchors, by)
        .join(rlc_of_group, [*scope, "ue_group"])
        .select(*scope, "ue_value", "rlc_ueid", F.lit(2).alias("tier"))
    )
    first_two = direct.unionByName(corr)
    scan_pairs = meas.where(F.col("rlc").isNotNull()).select(
        *scope, F.explode(F.array_distinct(F.array("enb", "mme"))).alias("ue_value"), F.col("rlc").alias("rlc_ueid")
    ).where(F.col("ue_value").isNotNull()).distinct()
    resolved = first_two.select(*scope, "ue_value").distinct()
    scan = req.join(scan_pairs, by).join(resolved, [*scope, "ue_value"], "left_anti").select(*scope, "ue_value", "rlc_ueid", F.lit(3).alias("tier"))
    out = first_two.unionByName(scan).groupBy(*scope, "ue_value", "rlc_ueid").agg(F.min("tier").alias("t"))
    tier = F.when(F.col("t") == 1, "direct").when(F.col("t") == 2, "correlation").otherwise("scan")
    return out.select(*scope, "ue_value", "rlc_ueid", tier.alias("tier"))


def measurements_for_ue(packets: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """F1 rows of the RLC ids each requested UE value resolves to."""
    scope = capture_scope(packets)
    ids = resolve_rlc_ids(packets, groups, requests).select(*scope, "ue_value", F.col("rlc_ueid"))
    meas = rsrp_rsrq(packets)
    return meas.join(ids, [*scope, "rlc_ueid"]).select(*meas.columns, "ue_value")
