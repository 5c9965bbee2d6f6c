"""DuckDB oracle texts for the SQL surface (Q1-Q3)."""

from __future__ import annotations

from sigtrace.operators.sqlsurface import UE_KEYS_COMPARED, UE_KEYS_IN_JSON, _synonyms_in_order
from sigtrace.oracle import q, with_packets

RUN_SQL_TEXT = """
SELECT protocol, message_type, COUNT(*) AS count,
       CAST(ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY protocol), 4) AS DOUBLE) AS pct_of_protocol,
       CAST(RANK() OVER (PARTITION BY protocol ORDER BY COUNT(*) DESC) AS BIGINT) AS rank_in_protocol
FROM packets WHERE message_type IS NOT NULL
GROUP BY protocol, message_type"""


def run_sql() -> str:
    return with_packets("\nSELECT * FROM (" + RUN_SQL_TEXT + ")")


def ue_filter_in_sql() -> str:
    digits = r"['\"]?([0-9]+)"
    order = [(k.replace(".", "[.]") + r"['\"]?:\s*" + digits, f) for k, f in UE_KEYS_IN_JSON.items()]
    order += [(k.replace(".", "[.]") + r"['\"]?\s*=\s*" + digits, f) for k, f in UE_KEYS_COMPARED.items()]
    field = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN {q(n)}" for p, n in order) + " END"
    value = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN regexp_extract(lower(text), {q(p)}, 1)" for p, _ in order) + " END"
    return with_packets(f""",
log AS (SELECT packet_number AS query_id,
          CASE WHEN packet_number % 2 = 0
               THEN 'SELECT * FROM packets WHERE protocol_fields_json LIKE ''%"' || map_entries(m)[2].key || '": "' || map_entries(m)[2].value || '"%'''
               ELSE 'SELECT * FROM packets WHERE ' || map_entries(m)[2].key || ' = ''' || map_entries(m)[2].value || '''' END AS text
        FROM pm WHERE len(map_keys(m)) >= 2)
SELECT query_id, text, {field} AS ue_field, {value} AS ue_value FROM log""")


def tag_message_types() -> str:
    rows = _synonyms_in_order()

    def case(idx: int) -> str:
        return "CASE " + " ".join(f"WHEN contains(lower(text), {q(r[0])}) THEN {q(r[idx])}" for r in rows) + " END"

    return with_packets(f""",
qs AS (SELECT packet_number AS question_id,
         'show ' || message_type || ' messages for ue ' || coalesce(ue_id, 'any') AS text
       FROM packets WHERE message_type IS NOT NULL)
SELECT question_id, text, {case(0)} AS matched, {case(1)} AS canonical, {case(2)} AS message_type_value FROM qs""")
