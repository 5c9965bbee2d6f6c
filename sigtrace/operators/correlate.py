"""UE identity correlation across protocol layers.

Identifiers seen together in one packet belong to one physical UE; the groups are
the connected components of that "seen together" graph, computed as a distributed
iterative job (:mod:`sigtrace.plans.components`) instead of an in-memory union-find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.functions.fields import GUTI_KEYS, IMSI_KEYS, M_TMSI_KEYS, RLC_KEYS, capture_scope, first_of, packet_key, val, with_fields
from sigtrace.plans.components import connected_components

# Identifier kinds, in the order the reference extracts them (fixed values).
ID_KINDS: list[tuple[str, list[str]]] = [
    ("rlc_ueid", RLC_KEYS),
    ("enb_ue_s1ap_id", ["s1ap.s1ap.ENB_UE_S1AP_ID"]),
    ("mme_ue_s1ap_id", ["s1ap.s1ap.MME_UE_S1AP_ID"]),
    ("m_tmsi", M_TMSI_KEYS),
    ("guti", GUTI_KEYS),
    ("imsi", IMSI_KEYS),
]


# NGAP identifiers, for callers that want 5G packets correlated too (``id_kinds=ID_KINDS + NGAP_KINDS``).
NGAP_KINDS: list[tuple[str, list[str]]] = [
    ("ran_ue_ngap_id", ["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID", "RAN_UE_NGAP_ID"]),
    ("amf_ue_ngap_id", ["ngap.AMF_UE_NGAP_ID", "ngap.ngap.AMF_UE_NGAP_ID", "AMF_UE_NGAP_ID"]),
]


# Kinds that name a UE in any capture; all others are counters of one network element, which start anew in every capture.
GLOBAL_KINDS = ["m_tmsi", "guti", "imsi"]


def _ids_array(m: Column, id_kinds: list[tuple[str, list[str]]] = ID_KINDS) -> Column:
    return F.filter(
        F.array(*[F.struct(F.lit(kind).alias("id_type"), first_of(m, keys).alias("value")) for kind, keys in id_kinds]),
        lambda s: s["value"].isNotNull(),
    )


def ue_identifiers(packets: DataFrame, id_kinds: list[tuple[str, list[str]]] = ID_KINDS) -> DataFrame:
    """G1: every UE identifier per packet: (packet_number, id_type, value, ts, ids_in_packet).

    ``id_kinds`` lists the kinds and, for each, the field names tried in order.
    """
    df = with_fields(packets)
    m = F.col("m")
    with_ids = df.select(*packet_key(df), val(m, "frame.frame.time").alias("ts"), _ids_array(m, id_kinds).alias("ids"))
    return with_ids.select(
        *packet_key(df),
        F.explode("ids").alias("i"),
        "ts",
        F.size("ids").cast("bigint").alias("ids_in_packet"),
    ).select(*packet_key(df), "i.id_type", "i.value", "ts", "ids_in_packet")


def _node(id_type: Column, value: Column, scope: list[str] = []) -> Column:  # noqa: B006
    """``type:value``; of a counter in a table of several captures ``type:value@capture``."""
    own = F.concat(id_type, F.lit(":"), value)
    return F.when(id_type.isin(GLOBAL_KINDS), own).otherwise(F.concat(own, F.lit("@"), F.coalesce(F.col(scope[0]), F.lit("")))) if scope else own


def ue_id_edges(packets: DataFrame, id_kinds: list[tuple[str, list[str]]] = ID_KINDS) -> DataFrame:
    """Distinct pairs of identifiers seen in one packet (packets with >= 2 ids).

    A packet holds one identifier per kind at most, so the pairs per packet are bounded.
    """
    df = with_fields(packets)
    scope = capture_scope(df)
    ids = df.select(*scope, _ids_array(F.col("m"), id_kinds).alias("ids")).where(F.size("ids") >= 2)
    idx = ids.select(*scope, F.posexplode("ids").alias("i", "x"), "ids")
    pairs = idx.select(
        *scope,
        F.col("x").alias("a"),
        F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"),
    )
    return pairs.select(
        *scope,
        F.col("a.id_type").alias("type_a"), F.col("a.value").alias("value_a"),
        F.col("b.id_type").alias("type_b"), F.col("b.value").alias("value_b"),
    ).distinct()


def ue_groups(packets: DataFrame, id_kinds: list[tuple[str, list[str]]] = ID_KINDS) -> DataFrame:
    """(ue_group, id_type, value, first_packet); ue_group = smallest key of its identifiers.

    Only identifiers from packets carrying two or more identifiers take part (as in
    the reference).  Star edges (every id to the packet's first id) give the same
    components as all pairs with fewer edges.

    In a table of several captures counters (``enb_ue_s1ap_id``, ``rlc_ueid``, ...) are different identifiers in each
    capture and ``GLOBAL_KINDS`` the same in all, so groups of two captures meet only in those; rows are
    (ue_group, capture, id_type, value, first_packet), one for each capture an identifier is seen in.
    """
    df = with_fields(packets)
    scope = capture_scope(df)
    # Multi-identifier packets only; materialised once (reliable checkpoint) because
    # both the node table and the edge list read it, and the iterative job follows.
    arr = (
        df.select(*packet_key(df), _ids_array(F.col("m"), id_kinds).alias("ids"))
        .where(F.size("ids") >= 2)
        .checkpoint()
    )
    nodes = (
        arr.select(*packet_key(df), F.explode("ids").alias("x"))
        .groupBy(*scope, F.col("x.id_type").alias("id_type"), F.col("x.value").alias("value"))
        .agg(F.min("packet_number").alias("first_packet"))
        .withColumn("node", _node(F.col("id_type"), F.col("value"), scope))
    )
    star = arr.select(
        *scope,
        _node(F.col("ids")[0]["id_type"], F.col("ids")[0]["value"], scope).alias("src"),
        F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("x"),
    ).select("src", _node(F.col("x.id_type"), F.col("x.value"), scope).alias("dst"))
    comp = connected_components(star)
    return nodes.join(comp, "node").select(F.col("component").alias("ue_group"), *scope, "id_type", "value", "first_packet")


def ue_group_stats(groups: DataFrame) -> DataFrame:
    """Number of groups, identifiers, and average identifiers per group (a global identifier counts once for all captures)."""
    scope = capture_scope(groups)
    total = F.countDistinct(F.struct(_node(F.col("id_type"), F.col("value"), scope))) if scope else F.count(F.lit(1))
    return groups.agg(
        F.countDistinct("ue_group").alias("total_groups"),
        total.alias("total_identifiers"),
    ).select(
        "total_groups",
        "total_identifiers",
        F.round(F.col("total_identifiers") / F.greatest(F.col("total_groups"), F.lit(1)), 4).alias("avg_ids_per_group"),
    )


def correlated_ids(groups: DataFrame, target: DataFrame) -> DataFrame:
    """Identifiers in the same group as each target ``(id_type, value)``; none if unknown.

    A target may name its capture; without one it is looked up in every capture (column ``t_capture`` says where).
    """
    scope, named = capture_scope(groups), capture_scope(target)
    t = target.select(*[F.col(c).alias(f"n_{c}") for c in named], F.col("id_type").alias("t_type"), F.col("value").alias("t_value"))
    same = (groups["id_type"] == t["t_type"]) & (groups["value"] == t["t_value"])
    if scope and named:
        same = same & (groups["capture"] == t["n_capture"])
    found = [F.col(c).alias(f"t_{c}") for c in scope]
    hit = groups.join(t, same, "inner").select(*found, "t_type", "t_value", F.col("ue_group").alias("g"))
    return hit.join(groups, hit["g"] == groups["ue_group"]).select(
        *[f"t_{c}" for c in scope], "t_type", "t_value", "ue_group", *scope, "id_type", "value", "first_packet"
    )


def expand_by_correlation(
    packets: DataFrame, groups: DataFrame, target: DataFrame, id_kinds: list[tuple[str, list[str]]] = ID_KINDS
) -> DataFrame:
    """All packets carrying any identifier correlated with the target."""
    scope = capture_scope(groups)
    ids = correlated_ids(groups, target).select(*scope, "id_type", "value").distinct()
    key = packet_key(packets)
    carriers = ue_identifiers(packets, id_kinds).join(ids, [*scope, "id_type", "value"], "left_semi").select(*key).distinct()
    return packets.join(carriers, key, "left_semi")


def smallest_id(packets: DataFrame, id_type: str) -> DataFrame:
    """One row ``(id_type, value)``: the smallest identifier of a kind (target picker)."""
    return (
        ue_identifiers(packets)
        .where((F.col("id_type") == id_type) & (F.col("ids_in_packet") >= 2))
        .agg(F.min("value").alias("value"))
        .select(F.lit(id_type).alias("id_type"), "value")
    )
