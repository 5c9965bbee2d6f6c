"""

Each ``register(name, oracle)(fn)`` turns an operator over the ``packets`` table into
a driver query ``(spark, sf_dir) -> DataFrame`` (see :mod:`sigtrace.registry`).
"""

from __future__ import annotations

from pyspark.sql import functions as _F

from sigtrace.operators import callflow as T
from sigtrace.operators import catalog as C
from sigtrace.operators import correlate as G
from sigtrace.operators import listing as E
from sigtrace.operators import lookup as V
from sigtrace.operators import measure as M
from sigtrace.operators import predicates as D
from sigtrace.operators import release as R
from sigtrace.operators import sqlsurface as Q
from sigtrace.oracle import basic_sql as BS
from sigtrace.oracle import callflow_sql as TS
from sigtrace.oracle import correlate_sql as GS
from sigtrace.oracle import lookup_sql as VS
from sigtrace.oracle import release_sql as RS
from sigtrace.oracle import sql_surface_sql as QS
from sigtrace.registry import register

# --- R: release-cause and handover-failure analysis -------------------------
register("decode_cause", RS.decode_cause)(R.decoded_causes)
register("release_events", RS.release_events)(R.release_events)
register("classify_cause", RS.classify_cause)(R.cause_classes)
register("ngap_ue_counts", RS.ngap_ue_counts)(R.ngap_ue_counts)
register("release_stats", RS.release_stats)(R.release_stats)
register("release_by_category", RS.release_by_category)(R.release_by_category)
register("release_category_ues", RS.release_category_ues)(R.release_category_ues)
register("release_by_cause", RS.release_by_cause)(R.release_by_cause)
register("ue_release_detail", RS.ue_release_detail)(R.ue_release_detail)
register("ue_procedure_timeline", RS.ue_procedure_timeline)(R.ue_procedure_timeline)
register("ue_procedure_totals", RS.ue_procedure_totals)(R.ue_procedure_totals)
register("handover_events", RS.handover_events)(R.handover_events)
register("handover_failures_by_ue", RS.handover_failures_by_ue)(R.handover_failures_by_ue)
register("handover_failures", RS.handover_failures)(R.handover_failures)
register("cause_notes", RS.cause_notes)(R.cause_notes)

# --- C: profiling and field catalog -----------------------------------------

PKT_COLS = ["packet_number", "timestamp_iso", "protocol", "message_type"]

register("table_profile", BS.table_profile)(C.table_profile)
register("top_protocols", BS.top_protocols)(C.top_protocols)
register("inspect_head", BS.inspect_head)(C.inspect_head)
register("explode_fields", BS.explode_fields)(C.explode_fields)
register("field_catalog", BS.field_catalog)(C.field_catalog)
register("field_samples", BS.field_samples)(lambda p: C.field_samples(p).select("field", "sample", "first_packet", "sample_rank"))
register("fields_by_prefix", BS.fields_by_prefix)(C.fields_by_prefix)
register("match_fields", BS.match_fields)(lambda p: C.match_fields(p, "rsrp"))
register("resolve_field", BS.resolve_field)(lambda p: C.resolve_field(p, "m_tmsi"))
register("field_families", BS.field_families)(C.field_families)
register("suggest_fields", BS.suggest_fields)(lambda p: C.suggest_fields(p, "ueid"))
register("distinct_message_types", BS.distinct_message_types)(C.distinct_message_types)

# --- D: predicates over packet fields ----------------------------------------
register("field_equals", BS.field_equals)(lambda p: D.field_equals(p, "ngap.ngap.procedureCode", "29").select(*PKT_COLS))
register("field_equals_any", BS.field_equals_any)(
    lambda p: D.field_equals_any(p, "m_tmsi", D.min_value(p, D.alias_keys("m_tmsi"))).select(*PKT_COLS)
)
register("has_field_like", BS.has_field_like)(lambda p: D.has_field_like(p, "rsrp").select(*PKT_COLS))
register("field_name_variants", BS.field_name_variants)(lambda p: D.field_name_variants(p, "q-RxLevMin").select(*PKT_COLS))
register("ue_anchor", BS.ue_anchor)(
    lambda p: D.ue_anchor(p, "ue", D.busiest_value(p, D.ANCHOR_KEYS["ran"])).select(*PKT_COLS)
)
register("sib_filter", BS.sib_filter)(lambda p: D.sib_filter(p, 3).select(*PKT_COLS))
register("message_type_in", BS.message_type_in)(lambda p: D.message_type_in(p, BS.MESSAGE_SPELLINGS).select(*PKT_COLS))
register("message_type_like", BS.message_type_like)(lambda p: D.message_type_like(p, "%Handover%").select(*PKT_COLS))
register("protocol_filter", BS.protocol_filter)(lambda p: D.protocol_filter(p, protocol="RRC", direction="UL").select(*PKT_COLS))

# --- E: canned aggregations and listings --------------------------------------
register("unique_ue_count", BS.unique_ue_count)(E.unique_ue_count)
register("ue_list", BS.ue_list)(E.ue_list)
register("ue_summary", BS.ue_summary)(E.ue_summary)
register("count_by_protocol", BS.count_by_protocol)(E.count_by_protocol)
register("packets_per_hour", BS.packets_per_hour)(E.packets_per_hour)
register("count_by_direction", BS.count_by_direction)(E.count_by_direction)
register("count_by_interface", BS.count_by_interface)(E.count_by_interface)
register("handover_outcome_counts", BS.handover_outcome_counts)(E.handover_outcome_counts)
register("ue_protocol_breakdown", BS.ue_protocol_breakdown)(E.ue_protocol_breakdown)
register("packet_timeline", BS.packet_timeline)(E.packet_timeline)
register("attached_ues", BS.attached_ues)(E.attached_ues)
register("handover_messages", BS.handover_messages)(E.handover_messages)
register("measurement_reports", BS.measurement_reports)(E.measurement_reports)

# --- G: UE identity correlation; F: measurements ------------------------------



def _enb_requests(p):
    from sigtrace.functions.fields import with_fields

    d = with_fields(p)
    v = d["m"]["s1ap.s1ap.ENB_UE_S1AP_ID"]
    return d.where(v.isNotNull()).select(v.alias("ue_value")).distinct()


register("ue_identifiers", GS.ue_identifiers)(G.ue_identifiers)
register("ue_id_edges", GS.ue_id_edges)(G.ue_id_edges)
register("ue_groups", GS.ue_groups)(G.ue_groups)
register("ue_group_stats", GS.ue_group_stats)(lambda p: G.ue_group_stats(G.ue_groups(p)))
register("correlated_ids", GS.correlated_ids)(lambda p: G.correlated_ids(G.ue_groups(p), G.smallest_id(p, "m_tmsi")))
register("expand_by_correlation", GS.expand_by_correlation)(
    lambda p: G.expand_by_correlation(p, G.ue_groups(p), G.smallest_id(p, "m_tmsi")).select(*PKT_COLS)
)
register("rsrp_rsrq", GS.rsrp_rsrq)(M.rsrp_rsrq)
register("resolve_rlc_ids", GS.resolve_rlc_ids)(lambda p: M.resolve_rlc_ids(p, G.ue_groups(p), _enb_requests(p)))
register("measurements_for_ue", GS.measurements_for_ue)(
    lambda p: M.measurements_for_ue(p, G.ue_groups(p), _enb_requests(p))
)

# --- T: call-flow tracing ------------------------------------------------------

register("ue_session", TS.ue_session)(
    lambda p: T.session_packets(p).select("session", "packet_number", "message_type", "ran", "amf")
)
register("ue_session_target", TS.ue_session_target)(
    lambda p: T.ue_session(p, D.busiest_value(p, [T.RAN])).select("target", "packet_number", "message_type", "ran", "amf", "own")
)
register("session_summary", TS.session_summary)(T.session_summary)
register("session_ids", TS.session_ids)(T.session_ids)
register("ran_id_evolution", TS.ran_id_evolution)(T.ran_id_evolution)
register("session_phases", TS.session_phases)(T.session_phases)
register("session_message_counts", TS.session_message_counts)(T.session_message_counts)
register("session_steps", TS.session_steps)(T.session_steps)
register("enriched_call_flow", TS.enriched_call_flow)(T.enriched_call_flow)
register("handover_flow", TS.handover_flow)(T.handover_flow)
register("handover_trace", TS.handover_trace)(
    lambda p: T.handover_trace(p).select("trace_ue", "packet_number", "timestamp_iso", "protocol", "message_type", "direction", "interface")
)
register("lte_call_flow", TS.lte_call_flow)(lambda p: T.lte_call_flow(p, "rlc_ueid"))
register("procedure_step_match", TS.procedure_step_match)(T.procedure_step_match)

register("ue_procedure_steps", TS.ue_procedure_steps)(T.ue_procedure_steps)

# --- V: field-value lookup -------------------------------------------------------

register("field_values", VS.field_values)(lambda p: V.field_values(p, "pdn_ipv4"))
register("field_value_distinct", VS.field_value_distinct)(lambda p: V.field_value_distinct(p, "pdn_ipv4"))
register("field_value_best", VS.field_value_best)(lambda p: V.field_value_best(p, "q-RxLevMin"))
register("value_search", VS.value_search)(
    lambda p: V.value_search(p, "ueid").select(
        "field", "value", "r_exact", "r_start", _F.col("r_len").cast("bigint").alias("r_len")
    )
)
register("plmn_tac", VS.plmn_tac)(V.plmn_tac)


def with_identities(p):
    """The packets with PLMN and TAC fields in some of them (the driver's events have none): see ``lookup_sql.IDENTITY_FIELDS``.

    Both texts go behind a one-element ``explode``, so each is worked out once per packet (as in ``with_fields``).
    """
    own = [c for c in p.columns if c not in ("message_type", "protocol_fields_json")]
    once = p.select(*own, "message_type", _F.explode(_F.array("protocol_fields_json")).alias("protocol_fields_json"))
    changed = _F.struct(_F.expr(VS.IDENTITY_MESSAGE).alias("message_type"), _F.expr(VS.IDENTITY_FIELDS).alias("protocol_fields_json"))
    return once.select(*own, _F.explode(_F.array(changed)).alias("x")).select(*own, "x.message_type", "x.protocol_fields_json")


register("plmn_tac_by_ue", VS.plmn_tac_by_ue)(lambda p: V.plmn_tac_by_ue(with_identities(p)))
register("plmn_tac_complete", VS.plmn_tac_complete)(lambda p: V.plmn_tac(with_identities(p), registration_complete=True))
register("value_search_for_ues", VS.value_search_for_ues)(lambda p: V.value_search_for_ues(with_identities(p), "tac", top=3))
register("pdn_ip", VS.pdn_ip)(V.pdn_ip)

# --- Q: SQL surface and query logs ------------------------------------------------

register("run_sql", QS.run_sql)(lambda p: Q.run_sql(p.sparkSession, p, QS.RUN_SQL_TEXT, limit=None))
register("ue_filter_in_sql", QS.ue_filter_in_sql)(lambda p: Q.ue_filter_in_sql(Q.sql_log_from_packets(p)))
register("tag_message_types", QS.tag_message_types)(lambda p: Q.tag_message_types(Q.questions_from_packets(p)))

# --- additional per-operator keys ------------------------------------------------------
register("ue_has_message", RS.ue_has_message)(lambda p: R.ue_has_message(p, R.ue_message_requests(p)))
register("classify_cause_standard", RS.classify_cause_standard)(
    lambda p: R.release_events(p).select("cause_raw").distinct().select(
        "cause_raw",
        _F.when(R.classify_standard(_F.col("cause_raw")), "NORMAL").otherwise("ABNORMAL").alias("standard_classification"),
    )
)


def _rsrp_values(p, token):
    from sigtrace.functions.fields import with_fields

    d = with_fields(p)
    vals = _F.filter(_F.map_entries("m"), lambda e: e["key"].contains(token))
    return d.select(_F.explode(vals).alias("e")).select(_F.col("e.value").try_cast("int").alias("value")).where(
        _F.col("value").isNotNull()
    ).distinct()


register("rsrp_to_dbm", GS.rsrp_to_dbm)(lambda p: _rsrp_values(p, "rsrpResult").select("value", M.rsrp_to_dbm(_F.col("value")).alias("text")))
register("rsrq_to_db", GS.rsrq_to_db)(lambda p: _rsrp_values(p, "rsrqResult").select("value", M.rsrq_to_db(_F.col("value")).alias("text")))

# A and B round trips (ingest and enrichment) register themselves on import.
from sigtrace import ingest_queries  # noqa: E402,F401

# Operators over a stored table of two captures.
from sigtrace import capture_queries  # noqa: E402,F401
