"""Predicates over packet fields (D1-D9) as row filters.

All filters are per-row expressions over the parsed map, so they compose with any
other ``where`` (Catalyst combines them) and filters on plain columns
(``protocol``, ``message_type``, ``direction``) reach the Parquet scan as pushed
filters.  Parameters that name "a UE" can be a literal or a DataFrame of
targets chosen by another query (see :func:`busiest_value`), which is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.functions import codes
from sigtrace.functions.fields import has_key, packet_key, val, with_fields

# ---------------------------------------------------------------------------
# FIXED VALUES: bare field names -> stored key paths (alias table of the reference).
# ---------------------------------------------------------------------------
FIELD_ALIASES: dict[str, list[str]] = {
    "ENB_UE_S1AP_ID": ["s1ap.s1ap.ENB_UE_S1AP_ID"],
    "MME_UE_S1AP_ID": ["s1ap.s1ap.MME_UE_S1AP_ID"],
    "m_TMSI": ["s1ap.s1ap.m_TMSI"],
    "M_TMSI": ["s1ap.s1ap.m_TMSI"],
    "Old_ENB_UE_X2AP_ID": ["x2ap.x2ap.Old_ENB_UE_X2AP_ID"],
    "New_ENB_UE_X2AP_ID": ["x2ap.x2ap.New_ENB_UE_X2AP_ID"],
    "rlc-lte.ueid": ["rlc_lte.rlc-lte.ueid"],
    "m_tmsi": ["s1ap.nas-eps.emm.m_tmsi", "nas_eps.nas-eps.emm.m_tmsi", "rlc_lte.nas-eps.emm.m_tmsi"],
    "imsi": ["s1ap.nas-eps.emm.imsi", "nas_eps.nas-eps.emm.imsi"],
}

# UE anchors: anchor kind -> every stored key spelling of that identifier.
ANCHOR_KEYS: dict[str, list[str]] = {
    "ran": ["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID", "RAN_UE_NGAP_ID"],
    "amf": ["ngap.AMF_UE_NGAP_ID", "ngap.ngap.AMF_UE_NGAP_ID", "AMF_UE_NGAP_ID"],
    "enb": ["s1ap.s1ap.ENB_UE_S1AP_ID"],
    "mme": ["s1ap.s1ap.MME_UE_S1AP_ID"],
}

# RRC messages that belong to a handover flow besides S1AP/X2AP handover procedures.
RRC_MOBILITY_MESSAGES = ["mobilityFromEUTRACommand", "rrcConnectionReconfiguration"]


def _value_in(m: Column, keys: Sequence[str], value: Column) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(val(m, k) == value, F.lit(False))
    return out


def field_equals(packets: DataFrame, key: str, value: str) -> DataFrame:
    """Packets where the field ``key`` equals ``value`` exactly.

    When the table carries the key as a materialised hot column (written by
    ``write_packets``), the predicate is on that column, so Parquet pushes it down and
    skips row groups by min/max statistics.
    """
    from sigtrace.sources.schema import HOT_KEYS

    hot = next((c for c, k in HOT_KEYS.items() if k == key and c in packets.columns), None)
    if hot is not None:
        return with_fields(packets.where(F.col(hot) == F.lit(value)))
    df = with_fields(packets)
    return df.where(val(F.col("m"), key) == F.lit(value))


def _pruned(packets: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that can have ``value`` under one of ``keys``, by the hot column of these spellings where the table has one.

    The filter is on plain columns, so it reaches the Parquet scan (statistics and Bloom filters skip row groups); the
    exact condition on the map follows.
    """
    from sigtrace.sources.schema import HOT_ALIASES, HOT_DIFFER

    hot = next((c for c, k in HOT_ALIASES.items() if set(k) == set(keys) and c in packets.columns and HOT_DIFFER in packets.columns), None)
    return packets if hot is None else packets.where((F.col(hot) == F.lit(value)) | F.col(HOT_DIFFER))


def alias_keys(name: str) -> list[str]:
    return FIELD_ALIASES.get(name, [name])


def field_equals_any(packets: DataFrame, name: str, value: str | DataFrame) -> DataFrame:
    """Packets where any stored spelling of ``name`` equals ``value``.

    ``value`` may be a DataFrame with column ``value``: targets picked by a query, any number.
    """
    keys = alias_keys(name)
    if isinstance(value, DataFrame):
        return _semi_on_values(with_fields(packets), keys, value.select(F.col("value").alias("_target")).distinct())
    return with_fields(_pruned(packets, keys, value)).where(_value_in(F.col("m"), keys, F.lit(value)))


def _alias_values(keys: Sequence[str]) -> Column:
    return F.array(*[val(F.col("m"), k) for k in keys])


def _semi_on_values(df: DataFrame, keys: Sequence[str] | Column, target: DataFrame) -> DataFrame:
    """Packets whose value under any of ``keys`` is one of the distinct ``target`` values (column ``_target``).

    An equi-join on the packet's distinct alias values, so no nested-loop join is needed;
    Spark broadcasts the targets where their size allows.  A packet whose spellings hold
    several values can match several targets; it is returned once.
    """
    arr = keys if isinstance(keys, Column) else _alias_values(keys)
    values = F.array_except(arr, F.array(F.lit(None).cast("string")))  # distinct, without nulls
    one = df.where(F.size(values) == 1).withColumn("_v", F.get(values, 0)).join(target, F.col("_v") == F.col("_target"), "left_semi")
    if not isinstance(keys, Column) and len(keys) == 1:
        return one.drop("_v")
    more = df.where(F.size(values) > 1)
    hit = more.select(*packet_key(df), F.explode(values).alias("_v")).join(target, F.col("_v") == F.col("_target"), "left_semi").select(*packet_key(df)).distinct()
    return one.drop("_v").unionByName(more.join(hit, packet_key(df), "left_semi"))


def has_field_like(packets: DataFrame, name: str) -> DataFrame:
    """D3: packets with any field name containing ``name`` (case-insensitive)."""
    df = with_fields(packets)
    n = name.lower()
    return df.where(has_key(F.col("m"), lambda k: F.lower(k).contains(n)))


def variant_normal_form(c: Column) -> Column:
    """D4 normal form: lower-case, no separators, ``physcell`` spelled ``phycell``."""
    return F.replace(F.regexp_replace(F.lower(c), r"[-_.\s]", ""), F.lit("physcell"), F.lit("phycell"))


def variant_normal_literal(s: str) -> str:
    import re

    return re.sub(r"[-_.\s]", "", s.lower()).replace("physcell", "phycell")


def field_name_variants(packets: DataFrame, name: str) -> DataFrame:
    """Packets having a field whose name matches ``name`` in any spelling variant
    (separators, case, camel/Pascal, phy/phys cell)."""
    df = with_fields(packets)
    target = F.lit(variant_normal_literal(name))
    return df.where(has_key(F.col("m"), lambda k: variant_normal_form(k).contains(target)))


def has_5g(packets: DataFrame) -> DataFrame:
    """One row: does any packet carry an NGAP field (technology default for 'ue id')."""
    df = with_fields(packets)
    return df.agg(F.max(has_key(F.col("m"), lambda k: F.lower(k).contains("ngap")).cast("int")).alias("has_5g"))


def ue_anchor(packets: DataFrame, anchor: str, value: str | DataFrame) -> DataFrame:
    """Packets of one UE by anchor kind (ran / amf / enb / mme / ue).

    ``ue`` means RAN when the dataset carries NGAP fields, else ENB; the choice is a
    one-row aggregate joined back, not a driver-side count.
    """
    if anchor != "ue" and not isinstance(value, DataFrame):
        keys = ANCHOR_KEYS[anchor]
        return with_fields(_pruned(packets, keys, str(value))).where(_value_in(F.col("m"), keys, F.lit(str(value))))
    df = with_fields(packets)
    if isinstance(value, DataFrame):
        target = value.select(F.col("value").alias("_target")).distinct()
    else:
        target = df.sparkSession.range(1).select(F.lit(str(value)).alias("_target"))
    if anchor == "ue":
        five_g = has_5g(df).scalar()  # scalar subquery: one value for the whole dataset
        n = max(len(ANCHOR_KEYS["ran"]), len(ANCHOR_KEYS["enb"]))
        pad = lambda ks: list(ks) + [ks[-1]] * (n - len(ks))  # noqa: E731  (same-length arrays)
        arr = F.when(five_g == 1, _alias_values(pad(ANCHOR_KEYS["ran"]))).otherwise(_alias_values(pad(ANCHOR_KEYS["enb"])))
        return _semi_on_values(df, arr, target)
    return _semi_on_values(df, ANCHOR_KEYS[anchor], target)


def sib_filter(packets: DataFrame, sib: int) -> DataFrame:
    """RRC broadcast packets holding SIB ``sib`` (never UE-filtered)."""
    df = with_fields(packets)
    tag = f"sib{sib}_element"
    return df.where((F.col("protocol") == "RRC") & has_key(F.col("m"), lambda k: k.contains(tag)))


def spelling_key(c: Column) -> Column:
    """Normal form of a message-type spelling: lower-case without blanks."""
    return F.regexp_replace(F.lower(c), r"\s", "")


def message_synonyms(spark) -> DataFrame:
    """The synonym dimension keyed by normalised spelling; first entry wins per key."""
    dim = codes.DIM_MESSAGE_SYNONYM.df(spark)
    return dim.select(spelling_key(F.col("spelling")).alias("skey"), "ord", "canonical", "value")


def resolve_message_types(spellings: DataFrame) -> DataFrame:
    """Spellings (column ``spelling``) -> canonical ``message_type`` value via the synonym table."""
    syn = message_synonyms(spellings.sparkSession)
    best = syn.groupBy("skey").agg(F.min_by(F.struct("canonical", "value"), F.col("ord")).alias("s"))
    return spellings.join(
        F.broadcast(best), spelling_key(F.col("spelling")) == F.col("skey"), "inner"
    ).select("spelling", F.col("s.canonical").alias("canonical"), F.col("s.value").alias("message_type"))


def canonical_message_values(spellings: Sequence[str]) -> list[str]:
    """Parameter resolution (no data): spellings -> message_type values via the fixed synonym table."""
    import re

    best: dict[str, tuple[int, str]] = {}
    for order, spelling, _canonical, value in codes.DIM_MESSAGE_SYNONYM.rows:
        key = re.sub(r"\s", "", spelling.lower())
        if key not in best or order < best[key][0]:
            best[key] = (order, value)
    out = []
    for s in spellings:
        hit = best.get(re.sub(r"\s", "", s.lower()))
        if hit and hit[1] not in out:
            out.append(hit[1])
    return out


def message_type_in(packets: DataFrame, spellings: Sequence[str]) -> DataFrame:
    """Packets whose message type is the canonical value of any given spelling.

    The spellings are parameters, resolved against the fixed synonym table before the
    query runs, so the filter is a plain ``IN`` list that reaches the Parquet scan.
    (:func:`resolve_message_types` does the same for a DataFrame of spellings.)
    """
    return packets.where(F.col("message_type").isin(canonical_message_values(spellings)))


def message_type_like(packets: DataFrame, pattern: str) -> DataFrame:
    """Message type matching a SQL LIKE pattern (e.g. ``%Attach%Request%``)."""
    return packets.where(F.col("message_type").like(pattern))


def protocol_filter(
    packets: DataFrame,
    protocol: str | None = None,
    protocol_prefix: str | None = None,
    interface: str | None = None,
    direction: str | None = None,
    ip: str | None = None,
) -> DataFrame:
    """Plain-column filters (pushed down to the Parquet scan)."""
    cond = F.lit(True)
    if protocol is not None:
        cond = cond & (F.col("protocol") == protocol)
    if protocol_prefix is not None:
        cond = cond & F.col("protocol").startswith(protocol_prefix)
    if interface is not None:
        cond = cond & (F.col("interface") == interface)
    if direction is not None:
        cond = cond & (F.col("direction") == direction)
    if ip is not None:
        cond = cond & ((F.col("source_ip") == ip) | (F.col("destination_ip") == ip))
    return packets.where(cond)


# ---------------------------------------------------------------------------
# Target pickers (so single-UE queries stay valid at every scale)
# ---------------------------------------------------------------------------
def busiest_value(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``value``: the id (over key aliases) on most packets; ties -> smallest number."""
    df = with_fields(packets)
    m = F.col("m")
    ids = df.select(F.explode(F.array_distinct(F.array(*[F.nullif(val(m, k), F.lit("")) for k in keys]))).alias("value"))
    counts = ids.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    as_number = F.expr("try_cast(value AS DECIMAL(38,0))")
    return counts.orderBy(F.desc("n"), as_number.asc_nulls_last(), F.asc("value")).limit(1).select("value")


def min_value(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``value``: the smallest id (string order) over the key aliases."""
    df = with_fields(packets)
    m = F.col("m")
    v = F.coalesce(*[F.nullif(val(m, k), F.lit("")) for k in keys])
    return df.agg(F.min(v).alias("value"))
