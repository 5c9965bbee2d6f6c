"""DuckDB oracle texts for call-flow tracing."""

from __future__ import annotations

from sigtrace.functions import codes
from sigtrace.operators.callflow import (
    DIM_PROCEDURE_STEP,
    HO_TRACE_KEYS,
    LTE_TRACE_KEYS,
    PHASES,
    RAN_VARIANTS,
    S1_PATTERNS,
    X2_PATTERNS,
)
from sigtrace.oracle import has_key, q, with_packets

SESSION_CTES = """,
ids AS (SELECT pm.*, nullif(m['ngap.ngap.RAN_UE_NGAP_ID'], '') AS ran, nullif(m['ngap.ngap.AMF_UE_NGAP_ID'], '') AS amf FROM pm),
pairs AS (SELECT DISTINCT ran AS p_ran, amf AS session FROM ids WHERE ran IS NOT NULL AND amf IS NOT NULL),
sp0 AS (SELECT ids.*, amf AS session FROM ids WHERE amf IS NOT NULL
        UNION ALL SELECT ids.*, pairs.session FROM ids JOIN pairs ON ids.ran = pairs.p_ran),
sp AS (SELECT DISTINCT ON (session, packet_number) * FROM sp0)"""


def ue_session() -> str:
    return with_packets(SESSION_CTES + "\nSELECT session, packet_number, message_type, ran, amf FROM sp")


def ue_session_target() -> str:
    """The packets of all AMF ids seen with the RAN id that has most packets (then the smallest id)."""
    return with_packets(SESSION_CTES + """,
target AS (SELECT ran FROM ids WHERE ran IS NOT NULL GROUP BY ran ORDER BY count(*) DESC, ran LIMIT 1),
mine AS (SELECT DISTINCT amf FROM ids WHERE ran = (SELECT ran FROM target) AND amf IS NOT NULL)
SELECT (SELECT ran FROM target) AS target, packet_number, any_value(message_type) AS message_type, any_value(ran) AS ran, any_value(amf) AS amf,
       coalesce(any_value(amf) IN (SELECT amf FROM mine), false) AS own
FROM sp WHERE session IN (SELECT amf FROM mine) GROUP BY packet_number""")


def session_ids() -> str:
    return with_packets(SESSION_CTES + """
SELECT DISTINCT session, 'ran' AS kind, ran AS id FROM sp WHERE amf = session AND ran IS NOT NULL
UNION ALL SELECT DISTINCT session, 'amf', amf FROM sp WHERE amf IS NOT NULL
UNION ALL SELECT DISTINCT session, 'pdu_session', e.value FROM (SELECT session, unnest(map_entries(m)) AS e FROM sp WHERE amf = session)
WHERE (contains(e.key, 'pDUSessionID') OR contains(e.key, 'PDUSessionID')) AND e.value <> ''""")


def ue_procedure_steps() -> str:
    hk = "coalesce(len(list_filter(map_keys(pm.m), lambda k: contains(k, s.match_value))) > 0, false)"
    return with_packets(f""",
s AS (SELECT * FROM {DIM_PROCEDURE_STEP.sql()}),
u AS (SELECT *, coalesce('enb:' || nullif(m['s1ap.s1ap.ENB_UE_S1AP_ID'], ''), 'enb:' || nullif(m['x2ap.x2ap.Old_ENB_UE_X2AP_ID'], ''),
   'enb:' || nullif(m['x2ap.x2ap.New_ENB_UE_X2AP_ID'], ''), 'rlc:' || nullif(m['rlc_lte.rlc-lte.ueid'], ''), 'm_tmsi:' || nullif(m['nas_eps.nas-eps.emm.m_tmsi'], '')) AS ue FROM pm),
h AS (SELECT pm.ue, s.procedure, s.step, count(*) AS packets, min(pm.packet_number) AS first_packet
      FROM u pm JOIN s ON pm.protocol = s.protocol AND (
        (s.match_kind = 'message_type' AND pm.message_type = s.match_value)
        OR (s.match_kind = 'identifier' AND (pm.message_type = s.match_value OR {hk})))
      WHERE pm.ue IS NOT NULL GROUP BY ALL),
begun AS (SELECT ue, procedure, sum(1::BIGINT << (step::INT - 1))::BIGINT AS steps_seen, count(*) AS done FROM h GROUP BY ALL),
sizes AS (SELECT procedure, count(*) AS total FROM s GROUP BY procedure)
SELECT b.ue, s.procedure, s.step::INT AS step, coalesce(h.packets, 0)::BIGINT AS packets, h.first_packet::DOUBLE AS first_packet, h.packets IS NOT NULL AS seen,
       b.steps_seen, b.done = sizes.total AS complete
FROM begun b JOIN s USING (procedure) JOIN sizes USING (procedure) LEFT JOIN h ON h.ue = b.ue AND h.procedure = s.procedure AND h.step = s.step""")


def session_summary() -> str:
    pdu = ("list_transform(list_filter(map_entries(m), lambda e: (contains(e.key, 'pDUSessionID') OR "
           "contains(e.key, 'PDUSessionID')) AND e.value <> ''), lambda e: e.value)")
    return with_packets(SESSION_CTES + f""",
pd AS (SELECT session, count(DISTINCT v) AS pdu_sessions FROM (SELECT session, unnest({pdu}) AS v FROM sp WHERE amf = session) GROUP BY session),
mn AS (SELECT session, count(DISTINCT CASE WHEN amf = session THEN ran END) AS ran_ids, count(*) AS messages,
         min(timestamp_iso) AS first_time, max(timestamp_iso) AS last_time,
         count(*) FILTER (WHERE message_type = 'HandoverPreparation' AND m['ngap.ngap.HandoverRequired_element'] IS NOT NULL) AS handover_attempts,
         count(*) FILTER (WHERE contains(message_type, 'Release')) AS releases,
         count(DISTINCT message_type) AS message_types FROM sp GROUP BY session)
SELECT mn.session, ran_ids, messages, first_time, last_time, coalesce(pdu_sessions, 0)::BIGINT AS pdu_sessions,
       handover_attempts, releases, message_types FROM mn LEFT JOIN pd USING (session)""")


def ran_id_evolution() -> str:
    return with_packets(SESSION_CTES + f""",
s3 AS (SELECT session, packet_number, ran, message_type, timestamp_iso,
              lag(ran) OVER (PARTITION BY session ORDER BY packet_number) AS prev_ran FROM sp WHERE ran IS NOT NULL)
SELECT session, packet_number, prev_ran AS previous_ran, ran AS new_ran, s3.message_type, substr(timestamp_iso, 1, 19) AS time,
  CASE WHEN prev_ran IS NOT NULL THEN coalesce(dim_ran_change_reason.reason, {q(codes.RAN_CHANGE_DEFAULT_REASON)}) END AS reason
FROM s3 LEFT JOIN {codes.DIM_RAN_CHANGE_REASON.sql()} ON dim_ran_change_reason.message_type = s3.message_type
WHERE prev_ran IS NULL OR prev_ran <> ran""")


def _branch(p: str, n: str, mt: str) -> str:
    return (f"CASE WHEN {mt} = 'InitialUEMessage' AND {n} > 0 THEN 0 "
            f"WHEN contains({mt}, 'HandoverPreparation') AND {p} <> 1 THEN 1 "
            f"WHEN {mt} = 'PathSwitchRequest' THEN 2 "
            f"WHEN contains({mt}, 'PDUSessionResourceSetup') AND {n} > 5 THEN 3 ELSE -1 END")


def _phase_name(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} = {i} THEN {q(name)}" for i, name in enumerate(PHASES)) + " END"


PHASE_CTES = SESSION_CTES + f""",
s4 AS (SELECT session, packet_number, coalesce(message_type, '') AS mt,
              row_number() OVER (PARTITION BY session ORDER BY packet_number) AS rn FROM sp),
rec(session, rn, packet_number, p, n, phase_no, opened) AS (
  SELECT session, rn, packet_number,
         CASE WHEN {_branch('0', '0', 'mt')} >= 0 THEN {_branch('0', '0', 'mt')} ELSE 0 END,
         CASE WHEN {_branch('0', '0', 'mt')} >= 0 THEN 1 ELSE 1 END,
         CASE WHEN {_branch('0', '0', 'mt')} >= 0 THEN 2 ELSE 1 END,
         {_branch('0', '0', 'mt')} >= 0
  FROM s4 WHERE rn = 1
  UNION ALL
  SELECT s.session, s.rn, s.packet_number,
         CASE WHEN {_branch('r.p', 'r.n', 's.mt')} >= 0 THEN {_branch('r.p', 'r.n', 's.mt')} ELSE r.p END,
         CASE WHEN {_branch('r.p', 'r.n', 's.mt')} >= 0 THEN 1 ELSE least(r.n + 1, 6) END,
         r.phase_no + CASE WHEN {_branch('r.p', 'r.n', 's.mt')} >= 0 THEN 1 ELSE 0 END,
         {_branch('r.p', 'r.n', 's.mt')} >= 0
  FROM rec r JOIN s4 s ON s.session = r.session AND s.rn = r.rn + 1),
ph AS (SELECT session, packet_number, phase_no, {_phase_name('p')} AS phase, opened, rn FROM rec)"""


def session_phases() -> str:
    return with_packets(PHASE_CTES + f"""
SELECT session, phase_no, any_value(phase) AS phase, min(packet_number) AS start_packet, max(packet_number) AS end_packet,
       count(*) AS messages FROM ph GROUP BY session, phase_no
UNION ALL
SELECT session, CAST(1 AS BIGINT), {q(PHASES[0])}, packet_number, packet_number, CAST(0 AS BIGINT) FROM ph WHERE rn = 1 AND opened""",
                        recursive=True)


def session_message_counts() -> str:
    return with_packets(SESSION_CTES + """,
c AS (SELECT session, message_type, count(*) AS count FROM sp WHERE message_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY count DESC, message_type) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10""")


def session_steps() -> str:
    gname = ("coalesce(CASE m['ngap.ngap.Cause'] " + " ".join(f"WHEN {q(g)} THEN {q(n)}" for g, n in codes.CAUSE_GROUPS.items())
             + " END, 'category-' || m['ngap.ngap.Cause'])")
    names = "CASE cv " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in codes.STEP_CAUSE_NAMES.items()) + " END"
    return with_packets(PHASE_CTES + f""",
st AS (SELECT sp.*, ph.phase_no, ph.phase,
              row_number() OVER (PARTITION BY sp.session, ph.phase_no ORDER BY sp.packet_number) AS index_in_phase
       FROM sp JOIN ph USING (session, packet_number)),
st2 AS (SELECT st.*, {gname} AS gname, m['ngap.ngap.' || {gname}] AS cv FROM st)
SELECT session, CAST(phase_no AS BIGINT) AS phase_no, phase, index_in_phase, packet_number, substr(timestamp_iso, 1, 19) AS time, message_type,
  CASE WHEN m['ngap.ngap.HandoverRequired_element'] IS NOT NULL THEN 'HandoverRequired'
       WHEN m['ngap.ngap.HandoverCommand_element'] IS NOT NULL THEN 'HandoverCommand'
       WHEN m['ngap.ngap.HandoverRequest_element'] IS NOT NULL THEN 'HandoverRequest' END AS sub_message,
  coalesce(m['ngap.ngap.RAN_UE_NGAP_ID'], '-') AS ran_ue_id, coalesce(m['ngap.ngap.AMF_UE_NGAP_ID'], '-') AS amf_ue_id,
  CASE WHEN m['ngap.ngap.Cause'] IS NOT NULL AND gname = 'radioNetwork' AND cv IS NOT NULL
       THEN gname || ': ' || coalesce({names}, 'code-' || cv) END AS cause
FROM st2""", recursive=True)


def enriched_call_flow() -> str:
    ngap = codes.Dim("dim_ngap_proc", ("code", "name"), tuple(codes.NGAP_PROCEDURES.items())).sql()
    mm = codes.Dim("dim_mm", ("code", "name"), tuple(codes.NAS_5GS_MM.items())).sql()
    sm = codes.Dim("dim_sm", ("code", "name"), tuple(codes.NAS_5GS_SM.items())).sql()
    anchors = "list_distinct(list_filter([" + ", ".join(f"m[{q(k)}]" for k in RAN_VARIANTS) + "], lambda x: x IS NOT NULL))"

    def code(x: str) -> str:
        return f"CASE WHEN starts_with(lower({x}), '0x') THEN CAST(CAST(('0x' || substr({x}, 3)) AS BIGINT) AS VARCHAR) ELSE {x} END"

    init = has_key("ends_with(k, 'initiatingMessage_element')")
    succ = has_key("ends_with(k, 'successfulOutcome_element')")
    unsu = has_key("ends_with(k, 'unsuccessfulOutcome_element')")
    return with_packets(f""",
a AS (SELECT packet_number, timestamp, m, unnest({anchors}) AS ue FROM pm),
b AS (SELECT a.*, lag(timestamp) OVER (PARTITION BY ue ORDER BY packet_number) AS prev_ts, m['ngap.ngap.procedureCode'] AS proc,
        coalesce(nullif(m['ngap.ngap.pDUSessionID'], ''), nullif(m['ngap.nas-5gs.pdu_session_id'], '')) AS pdu,
        coalesce(nullif(m['ngap.nas-5gs.sm.pdu_addr_inf_ipv4'], ''), nullif(m['ngap.nas-5gs.sm.pdu_addr_inf_ipv6'], '')) AS ue_ip,
        coalesce(nullif(m['sctp.sctp.srcport'], ''), nullif(m['sctp.srcport'], '')) AS srcp,
        coalesce(nullif(m['sctp.sctp.dstport'], ''), nullif(m['sctp.dstport'], '')) AS dstp,
        coalesce(nullif(m['ngap.nas-5gs.mm.message_type'], ''), nullif(m['nas-5gs.mm.message_type'], '')) AS mm,
        coalesce(nullif(m['ngap.nas-5gs.sm.message_type'], ''), nullif(m['nas-5gs.sm.message_type'], '')) AS sm
      FROM a),
c AS (SELECT b.*, dim_ngap_proc.name AS pname,
        CASE WHEN mm IS NOT NULL THEN coalesce(dim_mm.name, {code('mm')}) WHEN sm IS NOT NULL THEN coalesce(dim_sm.name, {code('sm')}) END AS nas_name,
        CASE WHEN {init} THEN 'initiating' WHEN {succ} THEN 'successfulOutcome' WHEN {unsu} THEN 'unsuccessfulOutcome' END AS outcome
      FROM b LEFT JOIN {ngap} ON dim_ngap_proc.code = b.proc
      LEFT JOIN {mm} ON dim_mm.code = {code('b.mm')} LEFT JOIN {sm} ON dim_sm.code = {code('b.sm')}),
d AS (SELECT ue AS ran_target, packet_number,
        strftime(epoch_ms(CAST(floor(round(timestamp * 1000000) / 1000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso_time,
        CAST(CAST(trunc((timestamp - prev_ts) * 1000) AS BIGINT) AS DOUBLE) AS delta_ms, proc AS procedure_code,
        coalesce(pname, CASE WHEN length(coalesce(proc, '')) > 0 THEN 'PROC_' || proc END, 'UNKNOWN') AS procedure_name,
        m['ngap.ngap.AMF_UE_NGAP_ID'] AS amf_ue_id, m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_id, pdu AS pdu_session_id, ue_ip,
        CASE WHEN m['ngap.ngap.DownlinkNASTransport_element'] IS NOT NULL OR coalesce(proc = '4', false) THEN 'DOWNLINK'
             WHEN m['ngap.ngap.UplinkNASTransport_element'] IS NOT NULL OR coalesce(proc = '46', false) THEN 'UPLINK'
             WHEN coalesce(srcp = '38412', false) THEN 'DOWNLINK' WHEN coalesce(dstp = '38412', false) THEN 'UPLINK' END AS flow_dir,
        nullif(concat_ws(', ', CASE WHEN coalesce(proc IN ('4', '46'), false) AND nas_name IS NOT NULL THEN 'NAS: ' || nas_name END,
                         'PDU=' || pdu, 'UE_IP=' || ue_ip, outcome), '') AS notes
      FROM c WHERE pname IS NOT NULL OR pdu IS NOT NULL OR ue_ip IS NOT NULL OR coalesce(proc = '4', false))
SELECT d.*, row_number() OVER (PARTITION BY ran_target ORDER BY packet_number) AS step FROM d""")


TRACE_CTE = ",\ntr AS (SELECT unnest(list_distinct(list_filter([" + ", ".join(
    f"m[{q(k)}]" for k in HO_TRACE_KEYS) + "], lambda x: x IS NOT NULL))) AS trace_ue, pm.* FROM pm)"


def handover_trace() -> str:
    return with_packets(TRACE_CTE + """
SELECT trace_ue, packet_number, timestamp_iso, protocol, message_type, direction, interface FROM tr""")


def _phase_case(patterns, mt: str) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({mt}, {q(p)})" for p in pats) + f" THEN {q(ph)}" for ph, pats in patterns
    ) + " END"


def handover_flow() -> str:
    mt = "lower(coalesce(message_type, ''))"
    spec = ("list_filter(list_transform(list_filter(map_keys(m), lambda k: (protocol = 'S1AP' AND contains(k, 's1ap.s1ap.') AND contains(k, '_element')) "
            "OR (protocol = 'X2AP' AND contains(k, 'x2ap.x2ap.') AND contains(k, '_element'))), "
            "lambda k: replace(replace(replace(k, 's1ap.s1ap.', ''), 'x2ap.x2ap.', ''), '_element', '')), "
            "lambda n: n <> '' AND contains(lower(n), 'handover'))[1]")
    return with_packets(TRACE_CTE + f""",
t1 AS (SELECT tr.*, CASE WHEN protocol = 'X2AP' THEN 'X2' WHEN protocol = 'S1AP' AND contains({mt}, 'handover') THEN 'S1' END AS ho_set FROM tr),
t2 AS (SELECT t1.*, last_value(ho_set IGNORE NULLS) OVER (PARTITION BY trace_ue ORDER BY packet_number
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ho_type FROM t1),
t3 AS (SELECT t2.*, CASE WHEN protocol = 'RRC' AND (contains({mt}, 'mobility') OR contains({mt}, 'reconfiguration')) THEN 'EXECUTION'
         WHEN ho_type = 'X2' THEN {_phase_case(X2_PATTERNS, mt)} WHEN ho_type = 'S1' THEN {_phase_case(S1_PATTERNS, mt)} END AS phase_set FROM t2),
t4 AS (SELECT t3.*, last_value(phase_set IGNORE NULLS) OVER (PARTITION BY trace_ue ORDER BY packet_number
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phase,
         row_number() OVER (PARTITION BY trace_ue ORDER BY packet_number) AS step,
         packet_number = max(packet_number) OVER (PARTITION BY trace_ue) AS is_last FROM t3)
SELECT trace_ue, step,
  CASE WHEN step = 1 THEN 'START' WHEN contains({mt}, 'failure') THEN 'FAIL'
       WHEN contains({mt}, 'acknowledge') OR contains({mt}, 'complete') THEN 'ACK' WHEN contains({mt}, 'notify') THEN 'NOTIFY'
       WHEN contains({mt}, 'release') AND is_last THEN 'END' WHEN contains({mt}, 'release') THEN 'RELEASE' ELSE '->' END AS flow,
  packet_number, timestamp_iso, protocol, coalesce({spec}, message_type) AS message_type,
  coalesce(nullif(m['s1ap.s1ap.ENB_UE_S1AP_ID'], ''), nullif(m['x2ap.x2ap.Old_ENB_UE_X2AP_ID'], ''),
           nullif(m['x2ap.x2ap.New_ENB_UE_X2AP_ID'], ''), nullif(m['rlc_lte.rlc-lte.ueid'], ''), '-') AS enb_ue_id,
  coalesce(nullif(m['s1ap.s1ap.MME_UE_S1AP_ID'], ''), '-') AS mme_ue_id,
  coalesce(nullif(direction, ''), '-') AS direction, coalesce(nullif(interface, ''), '-') AS interface,
  coalesce(phase, 'UNKNOWN') AS phase, coalesce(ho_type, 'UNKNOWN') AS ho_type
FROM t4""")


def lte_call_flow() -> str:
    keys = LTE_TRACE_KEYS["rlc_ueid"]
    ids = "list_distinct(list_filter([" + ", ".join(f"m[{q(k)}]" for k in keys) + "], lambda x: x IS NOT NULL))"
    return with_packets(f"""
SELECT unnest({ids}) AS trace_id, packet_number, timestamp_iso, protocol, message_type, direction, interface,
       substr(protocol_fields_json, 1, 200) AS summary, protocol_fields_json FROM pm""")


def procedure_step_match() -> str:
    hk = "coalesce(len(list_filter(map_keys(pm.m), lambda k: contains(k, s.match_value))) > 0, false)"
    return with_packets(f""",
s AS (SELECT * FROM {DIM_PROCEDURE_STEP.sql()}),
h AS (SELECT s.procedure, s.step, count(*) AS packets, min(pm.packet_number) AS first_packet
      FROM pm JOIN s ON pm.protocol = s.protocol AND (
        (s.match_kind = 'message_type' AND pm.message_type = s.match_value)
        OR (s.match_kind = 'identifier' AND (pm.message_type = s.match_value OR {hk})))
      GROUP BY 1, 2)
SELECT s.procedure, s.step, s.message, s.direction, s.protocol, coalesce(h.packets, 0)::BIGINT AS packets, CAST(h.first_packet AS DOUBLE) AS first_packet,
       h.packets IS NOT NULL AS seen
FROM s LEFT JOIN h ON h.procedure = s.procedure AND h.step = s.step""")
