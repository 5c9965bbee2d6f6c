"""DuckDB texts over two captures.

Where captures have nothing to do with each other the expected rows are those of each capture alone
(:func:`each_alone` runs an operator's single-capture text on one capture's packets at a time); groups of
identifiers, which global identifiers join across captures, have texts of their own.
"""

from __future__ import annotations

from sigtrace.oracle import with_packets
from sigtrace.oracle.correlate_sql import IDS_ARRAY
from sigtrace.sources.events_projection import duckdb_packets_sql

#: capture -> (condition, packet number) over the numbers of the common table
CAPTURES = {"north": ("packet_number % 3 = 0", "packet_number // 3"), "south": ("packet_number % 3 <> 0", "packet_number - packet_number // 3")}


def each_alone(text: str) -> str:
    whole = "packets AS (" + duckdb_packets_sql("events") + ")"
    if whole not in text:
        raise ValueError("the text does not start from the packets projection")
    parts = []
    for capture, (which, number) in CAPTURES.items():
        own = f"packets AS (SELECT * REPLACE ({number} AS packet_number) FROM ({duckdb_packets_sql('events')}) WHERE {which})"
        parts.append(f"SELECT '{capture}' AS capture, * FROM ({text.replace(whole, own)})")
    return "\nUNION ALL\n".join(parts)


_SCOPED = """,
numbered AS (SELECT * REPLACE (CASE WHEN packet_number % 3 = 0 THEN packet_number // 3 ELSE packet_number - packet_number // 3 END AS packet_number),
                CASE WHEN packet_number % 3 = 0 THEN 'north' ELSE 'south' END AS capture FROM pm),
pid AS (SELECT capture, packet_number, """ + IDS_ARRAY + """ AS ids FROM numbered),
seen AS (SELECT capture, packet_number, x.id_type AS id_type, x.value AS value,
                CASE WHEN x.id_type IN ('m_tmsi', 'guti', 'imsi') THEN x.id_type || ':' || x.value ELSE x.id_type || ':' || x.value || '@' || capture END AS node
         FROM (SELECT capture, packet_number, unnest(ids) AS x FROM pid WHERE len(ids) >= 2)),
nodes AS (SELECT capture, id_type, value, node, min(packet_number) AS first_packet FROM seen GROUP BY ALL),
und AS (SELECT DISTINCT a.node AS a, b.node AS b FROM seen a JOIN seen b USING (capture, packet_number)),
reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT u.b, r.root FROM reach r JOIN und u ON u.a = r.node),
comp AS (SELECT node, min(root) AS ue_group FROM reach GROUP BY node),
groups AS (SELECT ue_group, capture, id_type, value, first_packet, node FROM nodes JOIN comp USING (node))"""


def ue_groups() -> str:
    return with_packets(_SCOPED + "\nSELECT ue_group, capture, id_type, value, first_packet FROM groups", recursive=True)


def ue_group_stats() -> str:
    return with_packets(_SCOPED + """
SELECT count(DISTINCT ue_group) AS total_groups, count(DISTINCT node) AS total_identifiers,
       round(count(DISTINCT node) / greatest(count(DISTINCT ue_group), 1), 4)::DOUBLE AS avg_ids_per_group FROM groups""", recursive=True)


def expand_by_correlation() -> str:
    return with_packets(_SCOPED + """,
target AS (SELECT min(value) AS value FROM nodes WHERE id_type = 'enb_ue_s1ap_id' AND capture = 'north'),
mine AS (SELECT DISTINCT g2.capture, g2.id_type, g2.value FROM groups g1 JOIN groups g2 USING (ue_group)
         WHERE g1.capture = 'north' AND g1.id_type = 'enb_ue_s1ap_id' AND g1.value = (SELECT value FROM target))
SELECT capture, packet_number, timestamp_iso, protocol, message_type FROM numbered
WHERE (capture, packet_number) IN (
  SELECT p.capture, p.packet_number FROM (SELECT capture, packet_number, unnest(ids) AS x FROM pid) p
  JOIN mine ON mine.capture = p.capture AND mine.id_type = p.x.id_type AND mine.value = p.x.value)""", recursive=True)


def resolve_rlc_ids() -> str:
    return with_packets(_SCOPED + """,
req AS (SELECT DISTINCT capture, m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS ue_value FROM numbered WHERE m['s1ap.s1ap.ENB_UE_S1AP_ID'] IS NOT NULL),
rp AS (SELECT capture, m['rlc_lte.rlc-lte.ueid'] AS rlc, m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS enb, m['s1ap.s1ap.MME_UE_S1AP_ID'] AS mme
       FROM numbered WHERE len(list_filter(map_keys(m), lambda k: contains(k, 'rsrpResult'))) > 0),
t1 AS (SELECT DISTINCT req.capture, ue_value, ue_value AS rlc_ueid, 1 AS t FROM req JOIN rp ON rp.capture = req.capture AND rp.rlc = ue_value),
t2 AS (SELECT req.capture, req.ue_value, g2.value AS rlc_ueid, 2 AS t FROM req
       JOIN groups g1 ON g1.capture = req.capture AND g1.value = req.ue_value AND g1.id_type IN ('enb_ue_s1ap_id', 'mme_ue_s1ap_id', 'm_tmsi')
       JOIN groups g2 ON g2.ue_group = g1.ue_group AND g2.capture = g1.capture AND g2.id_type = 'rlc_ueid'),
t12 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
t3 AS (SELECT req.capture, req.ue_value, rp.rlc AS rlc_ueid, 3 AS t FROM req JOIN rp ON rp.capture = req.capture AND rp.rlc IS NOT NULL AND (rp.enb = req.ue_value OR rp.mme = req.ue_value)
       WHERE (req.capture, req.ue_value) NOT IN (SELECT (capture, ue_value) FROM t12))
SELECT capture, ue_value, rlc_ueid, CASE min(t) WHEN 1 THEN 'direct' WHEN 2 THEN 'correlation' ELSE 'scan' END AS tier
FROM (SELECT * FROM t12 UNION ALL SELECT * FROM t3) GROUP BY ALL""", recursive=True)
