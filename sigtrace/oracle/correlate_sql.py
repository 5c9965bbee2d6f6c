"""DuckDB oracle texts for identity correlation (G) and measurements (F)."""

from __future__ import annotations

from sigtrace.operators.correlate import ID_KINDS
from sigtrace.operators.measure import NEIGHBOUR_MARKERS, PCELL_RSRP_SUFFIX, PCELL_RSRQ_SUFFIX
from sigtrace.oracle import first_of, q, with_packets

IDS_ARRAY = "list_filter([" + ", ".join(
    f"{{'id_type': {q(kind)}, 'value': {first_of(keys)}}}" for kind, keys in ID_KINDS
) + "], lambda s: s.value IS NOT NULL)"

GROUPS_CTES = f""",
pid AS (SELECT packet_number, m['frame.frame.time'] AS ts, {IDS_ARRAY} AS ids FROM pm),
multi AS (SELECT packet_number, ids FROM pid WHERE len(ids) >= 2),
nodes AS (SELECT x.id_type AS id_type, x.value AS value, min(packet_number) AS first_packet,
                 x.id_type || ':' || x.value AS node
          FROM (SELECT packet_number, unnest(ids) AS x FROM multi) GROUP BY 1, 2),
edges AS (SELECT ids[1].id_type || ':' || ids[1].value AS a, x.id_type || ':' || x.value AS b
          FROM (SELECT ids, unnest(ids[2:]) AS x FROM multi)),
und AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT node, node FROM nodes),
reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT u.b, r.root FROM reach r JOIN und u ON u.a = r.node),
comp AS (SELECT node, min(root) AS ue_group FROM reach GROUP BY node),
groups AS (SELECT comp.ue_group, nodes.id_type, nodes.value, nodes.first_packet FROM nodes JOIN comp USING (node))"""


def ue_identifiers() -> str:
    return with_packets(""",
pid AS (SELECT packet_number, m['frame.frame.time'] AS ts, """ + IDS_ARRAY + """ AS ids FROM pm)
SELECT packet_number, x.id_type AS id_type, x.value AS value, ts, len(ids) AS ids_in_packet
FROM (SELECT packet_number, ts, ids, unnest(ids) AS x FROM pid)""")


def ue_id_edges() -> str:
    return with_packets(""",
pid AS (SELECT """ + IDS_ARRAY + """ AS ids FROM pm),
p AS (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM pid WHERE len(ids) >= 2),
pr AS (SELECT ids[i] AS a, unnest(ids[i + 1:]) AS b FROM p)
SELECT DISTINCT a.id_type AS type_a, a.value AS value_a, b.id_type AS type_b, b.value AS value_b FROM pr""")


def ue_groups() -> str:
    return with_packets(GROUPS_CTES + "\nSELECT * FROM groups", recursive=True)


def ue_group_stats() -> str:
    return with_packets(GROUPS_CTES + """
SELECT count(DISTINCT ue_group) AS total_groups, count(*) AS total_identifiers,
       round(count(*) / greatest(count(DISTINCT ue_group), 1), 4)::DOUBLE AS avg_ids_per_group FROM groups""",
                        recursive=True)


TARGET = """,
target AS (SELECT 'm_tmsi' AS id_type, min(value) AS value FROM nodes WHERE id_type = 'm_tmsi')"""


def correlated_ids() -> str:
    return with_packets(GROUPS_CTES + TARGET + """
SELECT t.id_type AS t_type, t.value AS t_value, g2.ue_group, g2.id_type, g2.value, g2.first_packet
FROM target t JOIN groups g1 ON g1.id_type = t.id_type AND g1.value = t.value
JOIN groups g2 ON g2.ue_group = g1.ue_group""", recursive=True)


def expand_by_correlation() -> str:
    return with_packets(GROUPS_CTES + TARGET + """,
cid AS (SELECT DISTINCT g2.id_type, g2.value FROM target t
        JOIN groups g1 ON g1.id_type = t.id_type AND g1.value = t.value JOIN groups g2 ON g2.ue_group = g1.ue_group),
carriers AS (SELECT DISTINCT packet_number FROM (SELECT packet_number, unnest(ids) AS x FROM pid) p
             JOIN cid ON cid.id_type = p.x.id_type AND cid.value = p.x.value)
SELECT packet_number, timestamp_iso, protocol, message_type FROM packets
WHERE packet_number IN (SELECT packet_number FROM carriers)""", recursive=True)


# --- F -------------------------------------------------------------------------
NEIGH = lambda k: "(" + " OR ".join(f"contains({k}, {q(mk)})" for mk in NEIGHBOUR_MARKERS) + ")"


def _first_int(token: str) -> str:
    return (
        "list_filter(list_transform(list_filter(map_entries(m), lambda e: e.value IS NOT NULL AND NOT "
        + NEIGH("e.key") + f" AND contains(e.key, {q(token)})), lambda e: TRY_CAST(e.value AS INTEGER)), lambda x: x IS NOT NULL)[1]"
    )


MEAS_CTE = f""",
mk AS (SELECT packet_number, timestamp_iso, m['rlc_lte.rlc-lte.ueid'] AS rlc_ueid, m,
  list_filter(map_keys(m), lambda k: ends_with(k, {q(PCELL_RSRP_SUFFIX)}))[1] AS kp,
  list_filter(map_keys(m), lambda k: ends_with(k, {q(PCELL_RSRQ_SUFFIX)}))[1] AS kq,
  coalesce(len(list_filter(map_keys(m), lambda k: ends_with(k, 'measResultPCell_element'))) > 0, false) AS has_pcell,
  coalesce(len(list_filter(map_keys(m), lambda k: {NEIGH('k')})) > 0, false) AS has_neigh,
  {_first_int('rsrpResult')} AS fp, {_first_int('rsrqResult')} AS fq FROM pm),
mv AS (SELECT packet_number, timestamp_iso, rlc_ueid,
  CASE WHEN kp IS NOT NULL AND kq IS NOT NULL THEN TRY_CAST(m[kp] AS INTEGER)
       WHEN has_pcell AND NOT (has_neigh AND (fp IS NULL OR fq IS NULL)) THEN fp END AS rsrp_result,
  CASE WHEN kp IS NOT NULL AND kq IS NOT NULL THEN TRY_CAST(m[kq] AS INTEGER)
       WHEN has_pcell AND NOT (has_neigh AND (fp IS NULL OR fq IS NULL)) THEN fq END AS rsrq_result FROM mk),
meas AS (SELECT packet_number, timestamp_iso, rlc_ueid, rsrp_result,
  CASE WHEN rsrp_result BETWEEN 0 AND 97 THEN (rsrp_result - 140)::VARCHAR || 'dBm to ' || (rsrp_result - 139)::VARCHAR || 'dBm'
       ELSE 'Unknown' END AS rsrp_dbm, rsrq_result,
  CASE WHEN rsrq_result BETWEEN 0 AND 34 THEN printf('%.1fdB to %.1fdB', -19.5 + rsrq_result * 0.5, -19.0 + rsrq_result * 0.5)
       ELSE 'Unknown' END AS rsrq_db
  FROM mv WHERE rsrp_result IS NOT NULL AND rsrq_result IS NOT NULL)"""


def rsrp_rsrq() -> str:
    return with_packets(MEAS_CTE + "\nSELECT * FROM meas")


RESOLVE_CTES = GROUPS_CTES + """,
req AS (SELECT DISTINCT m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS ue_value FROM pm WHERE m['s1ap.s1ap.ENB_UE_S1AP_ID'] IS NOT NULL),
rp AS (SELECT m['rlc_lte.rlc-lte.ueid'] AS rlc, m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS enb, m['s1ap.s1ap.MME_UE_S1AP_ID'] AS mme
       FROM pm WHERE coalesce(len(list_filter(map_keys(m), lambda k: contains(k, 'rsrpResult'))) > 0, false)),
t1 AS (SELECT req.ue_value, req.ue_value AS rlc_ueid, 1 AS t FROM req WHERE ue_value IN (SELECT rlc FROM rp WHERE rlc IS NOT NULL)),
t2 AS (SELECT req.ue_value, g2.value AS rlc_ueid, 2 AS t FROM req
       JOIN groups g1 ON g1.value = req.ue_value AND g1.id_type IN ('enb_ue_s1ap_id', 'mme_ue_s1ap_id', 'm_tmsi')
       JOIN groups g2 ON g2.ue_group = g1.ue_group AND g2.id_type = 'rlc_ueid'),
t12 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
t3 AS (SELECT req.ue_value, rp.rlc AS rlc_ueid, 3 AS t FROM req JOIN rp ON rp.rlc IS NOT NULL AND (rp.enb = req.ue_value OR rp.mme = req.ue_value)
       WHERE req.ue_value NOT IN (SELECT ue_value FROM t12)),
res AS (SELECT ue_value, rlc_ueid, CASE min(t) WHEN 1 THEN 'direct' WHEN 2 THEN 'correlation' ELSE 'scan' END AS tier
        FROM (SELECT * FROM t12 UNION ALL SELECT * FROM t3) GROUP BY ue_value, rlc_ueid)"""


def resolve_rlc_ids() -> str:
    return with_packets(RESOLVE_CTES + "\nSELECT * FROM res", recursive=True)


def measurements_for_ue() -> str:
    return with_packets(RESOLVE_CTES + MEAS_CTE + """
SELECT meas.*, res.ue_value FROM meas JOIN res ON meas.rlc_ueid = res.rlc_ueid""", recursive=True)


def _values(token: str) -> str:
    return f""",
v AS (SELECT DISTINCT TRY_CAST(e.value AS INTEGER) AS value FROM (SELECT unnest(map_entries(m)) AS e FROM pm)
      WHERE contains(e.key, {q(token)}) AND TRY_CAST(e.value AS INTEGER) IS NOT NULL)"""


def rsrp_to_dbm() -> str:
    return with_packets(_values("rsrpResult") + """
SELECT value, CASE WHEN value BETWEEN 0 AND 97 THEN (value - 140)::VARCHAR || 'dBm to ' || (value - 139)::VARCHAR || 'dBm'
                   ELSE 'Unknown' END AS text FROM v""")


def rsrq_to_db() -> str:
    return with_packets(_values("rsrqResult") + """
SELECT value, CASE WHEN value BETWEEN 0 AND 34 THEN printf('%.1fdB to %.1fdB', -19.5 + value * 0.5, -19.0 + value * 0.5)
                   ELSE 'Unknown' END AS text FROM v""")
