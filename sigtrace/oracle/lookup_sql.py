"""DuckDB oracle texts for field-value lookup (V1-V6)."""

from __future__ import annotations

from sigtrace.operators.catalog import IDENTITY_TOKENS
from sigtrace.operators.lookup import TAC_PATTERN, UE_ID_KEYS
from sigtrace.oracle import first_of, q, with_packets

ENTRIES = f""",
ent AS (SELECT packet_number, message_type, coalesce({first_of(UE_ID_KEYS)}, '') AS ue_id, e.key AS field, e.value AS value, pos
        FROM (SELECT packet_number, message_type, m, unnest(map_entries(m)) AS e,
                     unnest(range(1, len(map_entries(m)) + 1)) AS pos FROM pm))"""


def nk(x: str) -> str:
    return f"regexp_replace(lower({x}), '[-_.]', '', 'g')"


def _score(name: str) -> str:
    qn = name.lower().replace("-", "").replace("_", "").replace(".", "")
    ident = " + ".join(f"CASE WHEN contains(lower(field), {q(t)}) THEN 25 ELSE 0 END" for t in IDENTITY_TOKENS)
    return (f"(CASE WHEN {nk('field')} = {q(qn)} THEN 1000 ELSE 0 END + CASE WHEN contains({nk('field')}, {q(qn)}) THEN 100 ELSE 0 END"
            f" + CASE WHEN list_contains(string_split_regex(lower(field), '[._-]'), {q(qn)}) THEN 200 ELSE 0 END"
            f" - CASE WHEN contains(lower(field), 'flag') THEN 250 ELSE 0 END - CASE WHEN ends_with(lower(field), 'flag') THEN 50 ELSE 0 END"
            f" + {ident})")


def _values_cte(name: str) -> str:
    qn = name.lower().replace("-", "").replace("_", "").replace(".", "")
    term = name.lower().replace("-", "").replace("_", "").replace(" ", "")
    flag = "" if "flag" in name.lower() else "WHERE NOT contains(lower(field), 'flag')"
    return ENTRIES + f""",
nz AS (SELECT * FROM ent WHERE value IS NOT NULL AND value <> ''),
cand AS (SELECT DISTINCT field FROM nz WHERE contains({nk('field')}, {q(qn)}) OR contains({q(qn)}, {nk('field')})),
best AS (SELECT field FROM cand ORDER BY {_score(name)} DESC, field LIMIT 1),
ex AS (SELECT * FROM nz WHERE field IN (SELECT field FROM best)),
fz AS (SELECT * FROM nz WHERE contains({nk('field')}, {q(term)}) AND NOT EXISTS (SELECT 1 FROM ex)),
vals AS (SELECT DISTINCT ON (packet_number, field, value) packet_number, ue_id, field, value
         FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) {flag})"""


def field_values(name: str = "pdn_ipv4") -> str:
    return with_packets(_values_cte(name) + "\nSELECT * FROM vals")


def field_value_distinct(name: str = "pdn_ipv4") -> str:
    return with_packets(_values_cte(name) + """
SELECT value, arg_min(packet_number, packet_number) AS packet_number, arg_min(ue_id, packet_number) AS ue_id,
       arg_min(field, packet_number) AS field FROM vals GROUP BY value""")


def field_value_best(name: str = "q-RxLevMin") -> str:
    term = name.lower().replace("-", "").replace("_", "").replace(" ", "")
    spellings = sorted({name.lower(), name.lower().replace("-", "_"), name.lower().replace("_", "-"), term})
    ends = " OR ".join(f"ends_with(lower(field), {q(s)})" for s in spellings)
    return with_packets(ENTRIES + f""",
sc AS (SELECT packet_number, pos, field, value,
         {len(term)} + CASE WHEN ends_with({nk('field')}, {q(term)}) THEN 10 ELSE 0 END
         + CASE WHEN length(field) < 50 THEN 5 ELSE 0 END + CASE WHEN {ends} THEN 15 ELSE 0 END AS score
       FROM ent WHERE contains({nk('field')}, {q(term)}))
SELECT field, value, score, packet_number FROM sc ORDER BY score DESC, packet_number, pos LIMIT 1""")


def value_search(token: str = "ueid") -> str:
    t = token.lower().replace("-", "").replace("_", "").replace(" ", "")
    kn = "regexp_replace(lower(field), '[-_. ]', '', 'g')"
    return with_packets(ENTRIES + f""",
h AS (SELECT DISTINCT field, value FROM ent WHERE value IS NOT NULL AND value <> ''
      AND (contains({kn}, {q(t)}) OR contains({q(t)}, {kn})))
SELECT field, value, CASE WHEN {nk('field')} = {q(t)} THEN 0 ELSE 1 END AS r_exact,
       CASE WHEN strpos({nk('field')}, {q(t)}) = 1 THEN 0 ELSE 1 END AS r_start, length({nk('field')}) AS r_len
FROM h ORDER BY r_exact, r_start, r_len, field, value LIMIT 10""")


def plmn_tac() -> str:
    low = "lower(protocol_fields_json)"
    return with_packets(f""",
cand AS (SELECT * FROM pm WHERE (contains({low}, 'plmnidentity') OR contains({low}, 'plmn-id.mcc') OR contains({low}, 'plmn-id.mnc')
         OR contains({low}, 'tac'))),
r AS (SELECT packet_number,
  coalesce(list_filter(map_entries(m), lambda e: contains(lower(e.key), 'plmnidentity') AND e.value <> '')[1].value,
    CASE WHEN coalesce(list_filter(map_entries(m), lambda e: ends_with(lower(e.key), '.mcc'))[1].value, '') <> ''
          AND coalesce(list_filter(map_entries(m), lambda e: ends_with(lower(e.key), '.mnc'))[1].value, '') <> ''
         THEN 'MCC=' || list_filter(map_entries(m), lambda e: ends_with(lower(e.key), '.mcc'))[1].value
              || ', MNC=' || list_filter(map_entries(m), lambda e: ends_with(lower(e.key), '.mnc'))[1].value END) AS plmn,
  list_filter(map_entries(m), lambda e: regexp_matches(lower(e.key), {q(TAC_PATTERN)}) AND e.value <> '')[1].value AS tac
  FROM cand)
SELECT (SELECT plmn FROM r WHERE plmn IS NOT NULL ORDER BY packet_number LIMIT 1) AS plmn_identity,
       (SELECT tac FROM r WHERE tac IS NOT NULL ORDER BY packet_number LIMIT 1) AS tac""")


def pdn_ip() -> str:
    return with_packets("""
SELECT m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS ue_id, arg_min(m['s1ap.nas-eps.esm.pdn_ipv4'], packet_number) AS pdn_ip_address,
       min(packet_number) AS packet_number, arg_min(message_type, packet_number) AS message_type
FROM pm WHERE message_type LIKE '%InitialContextSetup%' AND m['s1ap.s1ap.ENB_UE_S1AP_ID'] IS NOT NULL
  AND m['s1ap.nas-eps.esm.pdn_ipv4'] IS NOT NULL
GROUP BY 1""")


# PLMN and TAC fields for some packets, in words that mean the same in both engines: uplink NAS packets whose number is
# divisible by 3 are Registration Completes with a TAC, initial messages carry a PLMN, of odd numbers as MCC and MNC, and a TAC.
IDENTITY_MESSAGE = "CASE WHEN message_type = 'UplinkNASTransport' AND packet_number % 3 = 0 THEN 'RegistrationComplete' ELSE message_type END"
IDENTITY_FIELDS = """CASE
 WHEN message_type = 'UplinkNASTransport' AND packet_number % 3 = 0 THEN
  concat(substring(protocol_fields_json, 1, length(protocol_fields_json) - 1), ', "ngap.ngap.tAC": "c', CAST(packet_number % 7 AS VARCHAR(20)), '"}')
 WHEN message_type = 'InitialUEMessage' AND packet_number % 2 = 0 THEN
  concat(substring(protocol_fields_json, 1, length(protocol_fields_json) - 1), ', "ngap.ngap.pLMNIdentity": "00f1', CAST(packet_number % 5 AS VARCHAR(20)), '", "ngap.ngap.tAC": "i', CAST(packet_number % 11 AS VARCHAR(20)), '", "ngap.ngap.contact_info": "none"}')
 WHEN message_type = 'InitialUEMessage' THEN
  concat(substring(protocol_fields_json, 1, length(protocol_fields_json) - 1), ', "ngap.e212.mcc": "26', CAST(packet_number % 3 AS VARCHAR(20)), '", "ngap.e212.mnc": "01", "ngap.x-tac": "i', CAST(packet_number % 11 AS VARCHAR(20)), '"}')
 ELSE protocol_fields_json END"""

_RAN = "coalesce(nullif(m['ngap.RAN_UE_NGAP_ID'], ''), nullif(m['ngap.ngap.RAN_UE_NGAP_ID'], ''), nullif(m['RAN_UE_NGAP_ID'], ''))"
_IDENTIFIED = f""",
named AS (SELECT packet_number, {IDENTITY_MESSAGE} AS message_type, {IDENTITY_FIELDS} AS j FROM packets),
nm AS (SELECT *, lower(j) AS low, CAST(j::JSON AS MAP(VARCHAR, VARCHAR)) AS m FROM named),
idr AS (SELECT packet_number, {_RAN} AS ue_id, message_type = 'RegistrationComplete' AS complete,
  coalesce(m['ngap.ngap.pLMNIdentity'], 'MCC=' || m['ngap.e212.mcc'] || ', MNC=' || m['ngap.e212.mnc']) AS plmn,
  coalesce(m['ngap.ngap.tAC'], m['ngap.x-tac']) AS tac
  FROM nm WHERE contains(low, 'plmnidentity') OR contains(low, 'tac'))"""


def _first_of(rows: str, by: str) -> str:
    return f"""
SELECT {by}arg_min(plmn, packet_number) FILTER (WHERE plmn IS NOT NULL) AS plmn_identity, arg_min(tac, packet_number) FILTER (WHERE tac IS NOT NULL) AS tac
FROM {rows} {'GROUP BY ue_id' if by else ''}"""


def plmn_tac_by_ue() -> str:
    return with_packets(_IDENTIFIED + """,
tiered AS (SELECT *, max(complete::INT) OVER (PARTITION BY ue_id) = 1 AS any_complete FROM idr WHERE ue_id IS NOT NULL),
chosen AS (SELECT * FROM tiered WHERE complete OR NOT any_complete)""" + _first_of("chosen", "ue_id, "))


def plmn_tac_complete() -> str:
    return with_packets(_IDENTIFIED + """,
chosen AS (SELECT * FROM idr WHERE complete OR NOT (SELECT bool_or(complete) FROM idr))""" + _first_of("chosen", ""))


def value_search_for_ues(token: str = "tac", top: int = 3) -> str:
    kn = "regexp_replace(lower(e.key), '[-_. ]', '', 'g')"
    return with_packets(_IDENTIFIED + f""",
ent AS (SELECT {_RAN} AS ue_id, unnest(map_entries(m)) AS e FROM nm),
hit AS (SELECT DISTINCT ue_id, e.key AS field, e.value AS value FROM ent
        WHERE e.value IS NOT NULL AND e.value <> '' AND (contains({kn}, {q(token)}) OR contains({q(token)}, {kn}))),
ranked AS (SELECT *, CASE WHEN {nk('field')} = {q(token)} THEN 0 ELSE 1 END AS a, CASE WHEN strpos({nk('field')}, {q(token)}) = 1 THEN 0 ELSE 1 END AS b, length({nk('field')}) AS c FROM hit),
own AS (SELECT *, row_number() OVER (PARTITION BY ue_id ORDER BY a, b, c, field, value) AS rank FROM ranked WHERE ue_id IS NOT NULL),
common AS (SELECT *, row_number() OVER (ORDER BY a, b, c, field, value) AS rank FROM (SELECT DISTINCT field, value, a, b, c FROM ranked)),
ues AS (SELECT DISTINCT {_RAN} AS ue_id FROM nm WHERE {_RAN} IS NOT NULL)
SELECT ue_id, true AS anchored, rank, field, value FROM own WHERE rank <= {top}
UNION ALL
SELECT ues.ue_id, false, rank, field, value FROM ues, common WHERE rank <= {top} AND ues.ue_id NOT IN (SELECT ue_id FROM own)""")
