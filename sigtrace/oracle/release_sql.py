"""DuckDB oracle texts for the release analysis."""

from __future__ import annotations

from sigtrace.functions import codes
from sigtrace.functions.fields import AMF_KEYS, NGAP_PROC_KEYS, RAN_KEYS
from sigtrace.oracle import any_contains, first_entry_value, first_of, has_key, keyword_case, q, with_packets

REL_KEY = "(contains(lower(k), 'release') AND (contains(lower(k), 'uecontext') OR contains(lower(k), 'ue_context')))"

GNAME = "CASE m['ngap.ngap.Cause'] " + " ".join(f"WHEN {q(g)} THEN {q(n)}" for g, n in codes.CAUSE_GROUPS.items()) + " END"

CATEGORY = lambda x: f"coalesce({keyword_case(x, codes.ABNORMAL_KEYWORDS)}, {keyword_case(x, codes.NORMAL_KEYWORDS)}, 'other')"
NORMAL = lambda x: f"({keyword_case(x, codes.ABNORMAL_KEYWORDS)} IS NULL)"

# Cause decoding shared by the release CTEs: dc = decoded text via a VALUES join.
CAUSE_CTES = f""",
c0 AS (SELECT pm.*, m['ngap.ngap.Cause'] AS cgrp, {GNAME} AS gname FROM pm),
c1 AS (SELECT c0.*, m['ngap.ngap.' || gname] AS cval FROM c0),
c2 AS (SELECT c1.*, CASE WHEN gname IS NOT NULL AND cval IS NOT NULL THEN coalesce(dim_cause.name, gname || '-' || cval) END AS decoded
       FROM c1 LEFT JOIN {codes.DIM_CAUSE.sql()} ON dim_cause.grp = c1.cgrp AND dim_cause.value = c1.cval),
c3 AS (SELECT c2.*, coalesce(nullif(decoded, ''),
          nullif({first_entry_value("contains(lower(e.key), 'cause')")}, ''),
          nullif({first_entry_value(any_contains('e.value', codes.CAUSE_HINT_WORDS))}, ''),
          'unspecified') AS cause_raw,
          coalesce(nullif(decoded, ''), 'unspecified') AS detail_cause,
          {first_of(NGAP_PROC_KEYS)} AS proc FROM c2)"""

_HAS_REQ = has_key("contains(lower(k), 'request')")
_HAS_CMD = has_key("contains(lower(k), 'command')")
RELEASE_TYPE = f"CASE WHEN {_HAS_REQ} THEN 'Request' WHEN {_HAS_CMD} THEN 'Command' ELSE 'Complete' END"

PROC_NAME_JOIN = codes.Dim(
    "dim_ngap_proc", ("code", "name"), tuple((k, v) for k, v in codes.NGAP_PROCEDURES.items())
).sql()

EVENTS_CTE = CAUSE_CTES + f""",
ev AS (SELECT packet_number, {first_of(RAN_KEYS)} AS ran_ue_id, {first_of(AMF_KEYS)} AS amf_ue_id,
          proc AS procedure_code, dim_ngap_proc.name AS procedure_name, cause_raw,
          {RELEASE_TYPE} AS release_type,
          {CATEGORY('cause_raw')} AS cause_category, {NORMAL('cause_raw')} AS normal
       FROM c3 LEFT JOIN {PROC_NAME_JOIN} ON dim_ngap_proc.code = c3.proc
       WHERE coalesce(proc IN ('41'), false) OR {has_key(REL_KEY)})"""

_HAS_IUE = has_key("contains(lower(k), 'initialuemessage')")
INITIAL_UE = (
    "(coalesce(message_type = '15', false) OR coalesce(proc = '15', false) "
    "OR coalesce(contains(lower(message_type), 'initialuemessage'), false) "
    f"OR {_HAS_IUE})"
)


def release_events() -> str:
    return with_packets(EVENTS_CTE + "\nSELECT * FROM ev")


def ngap_ue_counts() -> str:
    return with_packets(CAUSE_CTES + f"""
SELECT count(DISTINCT {first_of(RAN_KEYS)}) AS ran_total, count(DISTINCT {first_of(AMF_KEYS)}) AS amf_total,
       count(*) FILTER (WHERE {INITIAL_UE}) AS initial_ue_messages FROM c3""")


def release_stats() -> str:
    return with_packets(EVENTS_CTE + f""",
t AS (SELECT count(*) AS total_releases, count(*) FILTER (WHERE normal) AS normal_count,
             count(*) FILTER (WHERE NOT normal) AS abnormal_count FROM ev),
u AS (SELECT count(DISTINCT {first_of(RAN_KEYS)}) AS ran_total, count(DISTINCT {first_of(AMF_KEYS)}) AS amf_total,
             count(*) FILTER (WHERE {INITIAL_UE}) AS initial_ue_messages FROM c3),
r AS (SELECT *, CASE WHEN ran_total > 0 THEN abnormal_count * 100.0 / greatest(ran_total, 1) ELSE 0.0 END AS rate FROM t, u)
SELECT total_releases, normal_count, abnormal_count,
  round(CASE WHEN total_releases > 0 THEN normal_count * 100.0 / total_releases ELSE 0.0 END, 4)::DOUBLE AS normal_pct,
  round(CASE WHEN total_releases > 0 THEN abnormal_count * 100.0 / total_releases ELSE 0.0 END, 4)::DOUBLE AS abnormal_pct,
  ran_total, amf_total, initial_ue_messages, round(rate, 4)::DOUBLE AS failure_rate_pct,
  CASE WHEN rate < 50 THEN 'OK' WHEN rate < 100 THEN 'ELEVATED' ELSE 'HIGH' END AS status FROM r""")


def release_by_category() -> str:
    return with_packets(EVENTS_CTE + """
SELECT cause_category, count(*) FILTER (WHERE normal) AS normal, count(*) FILTER (WHERE NOT normal) AS abnormal,
       count(*) AS total, count(DISTINCT ran_ue_id) AS ues,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct_of_releases
FROM ev GROUP BY cause_category""")


def release_category_ues() -> str:
    return with_packets(EVENTS_CTE + """
SELECT cause_category, ran_ue_id, count(*) AS releases FROM ev WHERE ran_ue_id IS NOT NULL GROUP BY 1, 2""")


def _std_class(x: str) -> str:
    return (
        f"CASE WHEN coalesce(dim_cause_class.std_normal, {NORMAL(x)}) THEN 'NORMAL' ELSE 'ABNORMAL' END"
    )


def release_by_cause() -> str:
    return with_packets(EVENTS_CTE + f""",
g AS (SELECT cause_category, cause_raw, normal, count(*) AS count FROM ev GROUP BY 1, 2, 3)
SELECT cause_category, cause_raw, count, round(count * 100.0 / sum(count) OVER (), 4)::DOUBLE AS pct_of_releases,
       CASE WHEN normal THEN 'NORMAL' ELSE 'ABNORMAL' END AS classification,
       {_std_class('cause_raw')} AS standard_classification
FROM g LEFT JOIN {codes.DIM_CAUSE_CLASS.sql()} ON dim_cause_class.cause_name = g.cause_raw""")


def decode_cause() -> str:
    return with_packets(CAUSE_CTES + """
SELECT packet_number, cgrp AS cause_group, cval AS cause_value, decoded AS cause_name FROM c3 WHERE cgrp IS NOT NULL""")


def classify_cause() -> str:
    return with_packets(EVENTS_CTE + f"""
SELECT DISTINCT cause_raw, {CATEGORY('cause_raw')} AS cause_category, {NORMAL('cause_raw')} AS normal,
       {_std_class('cause_raw')} = 'NORMAL' AS standard_normal
FROM ev LEFT JOIN {codes.DIM_CAUSE_CLASS.sql()} ON dim_cause_class.cause_name = ev.cause_raw""")


DETAIL_WHERE = f"m['ngap.ngap.RAN_UE_NGAP_ID'] IS NOT NULL AND {has_key(REL_KEY)}"


def ue_release_detail() -> str:
    return with_packets(CAUSE_CTES + f"""
SELECT m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_id, packet_number, {RELEASE_TYPE} AS release_type,
       detail_cause AS cause, {CATEGORY('detail_cause')} AS category,
       CASE WHEN {NORMAL('detail_cause')} THEN 'NORMAL' ELSE 'ABNORMAL' END AS status
FROM c3 WHERE {DETAIL_WHERE}""")


def _timeline_body() -> str:
    return f"""
SELECT m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_id, packet_number, m['ngap.ngap.procedureCode'] AS procedure_code,
  CASE m['ngap.ngap.procedureCode'] WHEN '4' THEN 'DownlinkNASTransport' WHEN '14' THEN 'InitialContextSetup'
    WHEN '15' THEN 'InitialUEMessage' WHEN '21' THEN 'UEContextRelease' WHEN '29' THEN 'PDUSessionResourceSetup'
    ELSE 'Procedure-' || coalesce(m['ngap.ngap.procedureCode'], 'None') END AS procedure,
  coalesce(length(nullif(m['ngap.ngap.procedureCode'], '')) > 0, false) AS is_procedure,
  {has_key(REL_KEY)} AS is_release
FROM pm WHERE m['ngap.ngap.RAN_UE_NGAP_ID'] IS NOT NULL"""


def ue_procedure_timeline() -> str:
    return with_packets(_timeline_body())


def ue_procedure_totals() -> str:
    return with_packets(f""",
t AS ({_timeline_body()})
SELECT ran_ue_id, count(*) AS packets, count(*) FILTER (WHERE is_procedure) AS procedures,
       count(*) FILTER (WHERE is_release) AS releases FROM t GROUP BY ran_ue_id""")


HO_OUTCOME = "CASE WHEN cv IN (" + ", ".join(q(c) for c in codes.HO_FAILURE_CAUSES) + ") THEN 'failure' WHEN cv IN (" + ", ".join(q(c) for c in codes.HO_SUCCESS_CAUSES) + ") THEN 'success' END"


def _ho_events_cte() -> str:
    rn = codes.Dim("dim_rn", ("value", "name"), tuple(codes.CAUSE_RADIO_NETWORK.items())).sql()
    return f""",
h0 AS (SELECT nullif(m['ngap.ngap.RAN_UE_NGAP_ID'], '') AS ran_ue_id, packet_number, m['ngap.ngap.radioNetwork'] AS cv
       FROM pm WHERE nullif(m['ngap.ngap.RAN_UE_NGAP_ID'], '') IS NOT NULL AND {has_key(REL_KEY)}
       AND m['ngap.ngap.Cause'] = '0' AND m['ngap.ngap.radioNetwork'] IS NOT NULL),
he AS (SELECT ran_ue_id, packet_number, cv AS cause_code, coalesce(dim_rn.name, 'radioNetwork-' || cv) AS cause,
       {HO_OUTCOME} AS outcome FROM h0 LEFT JOIN {rn} ON dim_rn.value = h0.cv)"""


def handover_events() -> str:
    return with_packets(_ho_events_cte() + "\nSELECT * FROM he")


def handover_failures_by_ue() -> str:
    return with_packets(_ho_events_cte() + """
SELECT ran_ue_id, count(*) FILTER (WHERE outcome = 'failure') AS failure_count,
       count(*) FILTER (WHERE outcome = 'success') AS success_count FROM he GROUP BY ran_ue_id""")


def handover_failures() -> str:
    return with_packets(_ho_events_cte() + """,
pu AS (SELECT ran_ue_id, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE outcome = 'success') AS s
       FROM he GROUP BY ran_ue_id)
SELECT count(*) AS ues_with_events, count(*) FILTER (WHERE f > 0) AS ues_with_failures,
       count(*) FILTER (WHERE f = 0 AND s > 0) AS ues_success_only,
       coalesce(sum(f), 0)::BIGINT AS failures, coalesce(sum(s), 0)::BIGINT AS successes FROM pu""")


def cause_notes() -> str:
    note = "CASE " + " ".join(
        f"WHEN contains(cause, {q(p)}) THEN " + (f"replace({q(n)}, '{{cause}}', cause)" if "{cause}" in n else q(n))
        for p, n in codes.CAUSE_NOTES
    ) + " END"
    ho_note = "CASE " + " ".join(f"WHEN contains(cause, {q(p)}) THEN {q(n)}" for p, n in codes.HO_FAILURE_NOTES) + " END"
    reasons = "CASE " + " ".join(f"WHEN contains(cause, {q(p)}) THEN {q(n)}" for p, n in codes.HO_FAILURE_REASONS) + " END"
    return with_packets(CAUSE_CTES + _ho_events_cte() + f""",
d AS (SELECT DISTINCT detail_cause AS cause FROM c3 WHERE {DETAIL_WHERE}),
h AS (SELECT DISTINCT cause FROM he WHERE outcome = 'failure')
SELECT cause, {note} AS note, 'release' AS kind, CAST(NULL AS VARCHAR) AS possible_reasons FROM d
UNION ALL SELECT cause, {ho_note} AS note, 'handover_failure' AS kind, {reasons} AS possible_reasons FROM h""")


def ue_has_message() -> str:
    from sigtrace.operators.release import UE_MESSAGE_QUESTIONS

    def sq(x: str) -> str:
        return f"regexp_replace(lower({x}), '[ \\-_]', '', 'g')"

    def pref(a: str, b: str) -> str:
        t = f"CAST(floor(least(length({a}), length({b})) * 0.8) AS INTEGER)"
        return f"((length({a}) > 5 OR length({b}) > 5) AND substr({a}, 1, {t}) = substr({b}, 1, {t}))"

    fnorm = "replace(replace(replace(replace(replace(lower(k), '.', ''), 'ngap', ''), '_element', ''), '_', ''), '-', '')"
    qs = ", ".join(q(x) for x in UE_MESSAGE_QUESTIONS)
    return with_packets(f""",
pk AS (SELECT packet_number, timestamp_iso, message_type, m, nullif(m['ngap.ngap.RAN_UE_NGAP_ID'], '') AS ue_id FROM pm),
ids AS (SELECT DISTINCT ue_id FROM pk WHERE ue_id IS NOT NULL),
req AS (SELECT ue_id, unnest([{qs}]) AS message FROM ids),
j AS (SELECT pk.*, req.message, {sq('req.message')} AS qn, {sq('pk.message_type')} AS pn FROM pk JOIN req USING (ue_id)),
k AS (SELECT j.*,
   coalesce(length(nullif(message_type, '')) > 0, false) AND (contains(qn, pn) OR contains(pn, qn) OR {pref('qn', 'pn')}) AS by_type,
   list_filter(map_keys(m), lambda k: (contains(k, '_element') OR contains(k, 'Transfer'))
       AND (contains(qn, {fnorm}) OR contains({fnorm}, qn) OR {pref('qn', fnorm)}))[1] AS sub_key FROM j),
s AS (SELECT k.*, CASE WHEN NOT by_type THEN replace(string_split(sub_key, '.')[-1], '_element', '') END AS sub FROM k)
SELECT ue_id, message, packet_number,
       CASE WHEN sub IS NOT NULL THEN message_type || ' (' || sub || ')' ELSE message_type END AS matched_message,
       substr(timestamp_iso, 1, 23) AS time
FROM s WHERE by_type OR sub IS NOT NULL""")


def classify_cause_standard() -> str:
    return with_packets(EVENTS_CTE + f"""
SELECT DISTINCT cause_raw, {_std_class('cause_raw')} AS standard_classification
FROM ev LEFT JOIN {codes.DIM_CAUSE_CLASS.sql()} ON dim_cause_class.cause_name = ev.cause_raw""")
