"""DuckDB oracle texts for profiling, catalog, predicates and listings (C, D, E)."""

from __future__ import annotations

from collections.abc import Sequence

from sigtrace.functions import codes
from sigtrace.oracle import first_of, has_key, q, with_packets

EXPLODED = """,
fe AS (SELECT packet_number, message_type, e.key AS field, e.value AS value
       FROM (SELECT packet_number, message_type, unnest(map_entries(m)) AS e FROM pm))"""

CATALOG = EXPLODED + """,
cat AS (SELECT message_type, field, count(*) AS packets FROM fe WHERE message_type IS NOT NULL GROUP BY 1, 2)"""


def norm3(x: str) -> str:
    return f"regexp_replace(lower({x}), '[-_.]', '', 'g')"


def busiest_cte(keys: Sequence[str], name: str = "target") -> str:
    arr = "[" + ", ".join(f"nullif(m[{q(k)}], '')" for k in keys) + "]"
    return f""",
{name}_ids AS (SELECT unnest(list_distinct(list_filter({arr}, lambda x: x IS NOT NULL))) AS value FROM pm),
{name} AS (SELECT value FROM {name}_ids GROUP BY value
           ORDER BY count(*) DESC, TRY_CAST(value AS DECIMAL(38,0)) ASC NULLS LAST, value LIMIT 1)"""


def value_in(keys: Sequence[str], value: str) -> str:
    return "(" + " OR ".join(f"coalesce(m[{q(k)}] = {value}, false)" for k in keys) + ")"


# --- C ----------------------------------------------------------------------
def table_profile() -> str:
    return with_packets("""
SELECT count(*) AS row_count, CAST(14 AS BIGINT) AS column_count, min(timestamp) AS min_timestamp,
       max(timestamp) AS max_timestamp FROM packets""")


def top_protocols() -> str:
    return with_packets("""
SELECT protocol, count(*) AS count FROM packets WHERE protocol IS NOT NULL GROUP BY protocol
ORDER BY count DESC, protocol LIMIT 10""")


def inspect_head() -> str:
    return with_packets("""
SELECT packet_number, timestamp_iso, protocol, message_type FROM packets ORDER BY packet_number LIMIT 10""")


def explode_fields() -> str:
    return with_packets(EXPLODED + "\nSELECT * FROM fe")


def field_catalog() -> str:
    return with_packets(CATALOG + "\nSELECT * FROM cat")


def field_samples() -> str:
    return with_packets(EXPLODED + """,
s AS (SELECT field, substr(coalesce(value, 'None'), 1, 50) AS sample, min(packet_number) AS first_packet
      FROM fe GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_packet, sample) AS sample_rank FROM s)
SELECT field, sample, first_packet, sample_rank FROM r WHERE sample_rank <= 3""")


def fields_by_prefix() -> str:
    return with_packets(CATALOG + """,
f AS (SELECT message_type, CASE WHEN contains(field, '.') THEN split_part(field, '.', 1) ELSE 'other' END AS prefix,
             field FROM cat),
r AS (SELECT *, row_number() OVER (PARTITION BY message_type, prefix ORDER BY field) AS rn,
             count(*) OVER (PARTITION BY message_type, prefix) AS n FROM f)
SELECT message_type, prefix, string_agg(field, ', ' ORDER BY field) AS fields, greatest(max(n) - 10, 0)::BIGINT AS more
FROM r WHERE rn <= 10 GROUP BY message_type, prefix""")


def match_fields(query: str = "rsrp") -> str:
    qn = query.lower().replace("-", "").replace("_", "").replace(".", "")
    return with_packets(CATALOG + f"""
SELECT message_type, field FROM cat
WHERE contains({norm3('field')}, {q(qn)}) OR contains({q(qn)}, {norm3('field')})""")


def resolve_field(query: str = "m_tmsi") -> str:
    from sigtrace.operators.catalog import IDENTITY_TOKENS

    qn = query.lower().replace("-", "").replace("_", "").replace(".", "")
    ident = " + ".join(f"CASE WHEN contains(lower(field), {q(t)}) THEN 25 ELSE 0 END" for t in IDENTITY_TOKENS)
    return with_packets(CATALOG + f""",
mf AS (SELECT message_type, field FROM cat
       WHERE contains({norm3('field')}, {q(qn)}) OR contains({q(qn)}, {norm3('field')})),
sc AS (SELECT message_type, field,
  (CASE WHEN {norm3('field')} = {q(qn)} THEN 1000 ELSE 0 END
   + CASE WHEN contains({norm3('field')}, {q(qn)}) THEN 100 ELSE 0 END
   + CASE WHEN list_contains(string_split_regex(lower(field), '[._-]'), {q(qn)}) THEN 200 ELSE 0 END
   - CASE WHEN contains(lower(field), 'flag') THEN 250 ELSE 0 END
   - CASE WHEN ends_with(lower(field), 'flag') THEN 50 ELSE 0 END
   + {ident}) AS score FROM mf),
r AS (SELECT *, row_number() OVER (PARTITION BY message_type ORDER BY score DESC, field) AS rn FROM sc)
SELECT message_type, field, score FROM r WHERE rn = 1""")


def field_families() -> str:
    fam = ("CASE WHEN contains(field, 's1ap.s1ap.') THEN 's1ap' WHEN contains(field, 'x2ap.x2ap.') THEN 'x2ap' "
           "WHEN contains(field, 'rlc_lte.lte-rrc.') OR contains(field, 'rlc_lte.rlc-lte.') THEN 'rrc' "
           "WHEN contains(lower(field), 'nas') THEN 'nas' END")
    return with_packets(EXPLODED + f""",
k AS (SELECT DISTINCT field FROM fe),
f AS (SELECT field, {fam} AS family FROM k)
SELECT field, family,
  CASE WHEN family IN ('s1ap', 'x2ap') THEN contains(field, 'UE') AND contains(field, 'ID')
       WHEN family = 'rrc' THEN contains(lower(field), 'ueid')
       WHEN family = 'nas' THEN contains(lower(field), 'tmsi') OR contains(lower(field), 'imsi')
       ELSE false END AS is_ue_id
FROM f WHERE family IS NOT NULL""")


def suggest_fields(token: str = "ueid") -> str:
    tn = token.lower().replace("-", "").replace("_", "")
    fn = "regexp_replace(lower(field), '[-_]', '', 'g')"
    return with_packets(EXPLODED + f""",
k AS (SELECT DISTINCT field FROM fe)
SELECT field FROM k WHERE contains({fn}, {q(tn)}) OR contains({q(tn)}, {fn}) ORDER BY field LIMIT 6""")


def distinct_message_types() -> str:
    return with_packets("\nSELECT DISTINCT message_type FROM packets WHERE message_type IS NOT NULL")


# --- D ----------------------------------------------------------------------
PKT_COLS = "packet_number, timestamp_iso, protocol, message_type"


def field_equals() -> str:
    return with_packets(f"\nSELECT {PKT_COLS} FROM pm WHERE m['ngap.ngap.procedureCode'] = '29'")


def field_equals_any() -> str:
    from sigtrace.operators.predicates import FIELD_ALIASES

    keys = FIELD_ALIASES["m_tmsi"]
    return with_packets(f""",
target AS (SELECT min({first_of(keys)}) AS value FROM pm)
SELECT {PKT_COLS} FROM pm WHERE {value_in(keys, '(SELECT value FROM target)')}""")


def has_field_like() -> str:
    hk = has_key("contains(lower(k), 'rsrp')")
    return with_packets(f"\nSELECT {PKT_COLS} FROM pm WHERE {hk}")


def field_name_variants() -> str:
    nk = "replace(regexp_replace(lower(k), '[-_.\\s]', '', 'g'), 'physcell', 'phycell')"
    pred = f"contains({nk}, 'qrxlevmin')"
    return with_packets(f"\nSELECT {PKT_COLS} FROM pm WHERE {has_key(pred)}")


def ue_anchor() -> str:
    from sigtrace.operators.predicates import ANCHOR_KEYS

    g5 = has_key("contains(lower(k), 'ngap')")
    return with_packets(busiest_cte(ANCHOR_KEYS["ran"]) + f""",
five AS (SELECT max(CAST({g5} AS INT)) AS has_5g FROM pm)
SELECT {PKT_COLS} FROM pm
WHERE CASE WHEN (SELECT has_5g FROM five) = 1 THEN {value_in(ANCHOR_KEYS['ran'], '(SELECT value FROM target)')}
           ELSE {value_in(ANCHOR_KEYS['enb'], '(SELECT value FROM target)')} END""")


def sib_filter() -> str:
    hk = has_key("contains(k, 'sib3_element')")
    return with_packets(f"\nSELECT {PKT_COLS} FROM pm WHERE protocol = 'RRC' AND {hk}")


MESSAGE_SPELLINGS = ["handover required", "Measurement Report", "rrc connection setup complete",
                     "initial context setup request"]


def message_type_in() -> str:
    spell = ", ".join(f"({q(s)})" for s in MESSAGE_SPELLINGS)
    return with_packets(f""",
syn AS (SELECT regexp_replace(lower(spelling), '\\s', '', 'g') AS skey, ord, canonical, value FROM {codes.DIM_MESSAGE_SYNONYM.sql()}),
best AS (SELECT skey, arg_min(value, ord) AS value FROM syn GROUP BY skey),
wanted AS (SELECT DISTINCT best.value AS message_type FROM (VALUES {spell}) AS s(spelling)
           JOIN best ON best.skey = regexp_replace(lower(s.spelling), '\\s', '', 'g'))
SELECT {PKT_COLS} FROM pm WHERE message_type IN (SELECT message_type FROM wanted)""")


def message_type_like() -> str:
    return with_packets(f"\nSELECT {PKT_COLS} FROM packets WHERE message_type LIKE '%Handover%'")


def protocol_filter() -> str:
    return with_packets(f"\nSELECT {PKT_COLS} FROM packets WHERE protocol = 'RRC' AND direction = 'UL'")


# --- E ----------------------------------------------------------------------
def unique_ue_count() -> str:
    return with_packets("\nSELECT count(DISTINCT ue_id) AS unique_ues FROM packets WHERE ue_id IS NOT NULL")


def ue_list() -> str:
    return with_packets("\nSELECT DISTINCT ue_id FROM packets WHERE ue_id IS NOT NULL")


def ue_summary() -> str:
    return with_packets(""",
t AS (SELECT ue_id, message_type, min(packet_number) AS f, max(packet_number) AS l, count(*) AS n
      FROM packets WHERE ue_id IS NOT NULL GROUP BY 1, 2)
SELECT ue_id, min(f) AS first_packet, max(l) AS last_packet, sum(n)::BIGINT AS packets,
       string_agg(message_type, ',' ORDER BY message_type) AS message_types FROM t GROUP BY ue_id""")


def _count_by(col: str) -> str:
    return with_packets(f"\nSELECT {col}, count(*) AS count FROM packets WHERE {col} IS NOT NULL GROUP BY {col}")


def count_by_protocol() -> str:
    return _count_by("protocol")


def count_by_direction() -> str:
    return _count_by("direction")


def count_by_interface() -> str:
    return _count_by("interface")


def packets_per_hour() -> str:
    return with_packets("""
SELECT strftime(timestamp_hour, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS packet_count FROM packets GROUP BY 1""")


def handover_outcome_counts() -> str:
    return with_packets("""
SELECT message_type, count(*) AS count FROM packets WHERE protocol = 'X2AP' AND message_type LIKE '%Handover%'
GROUP BY message_type""")


def ue_protocol_breakdown() -> str:
    return with_packets("""
SELECT ue_id, protocol, message_type, count(*) AS count FROM packets WHERE ue_id IS NOT NULL GROUP BY 1, 2, 3""")


def packet_timeline() -> str:
    return with_packets("\nSELECT packet_number, timestamp, protocol, message_type FROM packets ORDER BY timestamp, packet_number")


def attached_ues() -> str:
    rrc = "(message_type = 'rrcConnectionSetupComplete' OR " + has_key("contains(k, 'rrcConnectionSetupComplete')") + ")"
    return with_packets(f"""
SELECT DISTINCT packet_number, timestamp_iso, ue_id, protocol, message_type FROM pm
WHERE coalesce({rrc} OR (protocol = 'NAS_EPS' AND message_type IN ('66', 'Attach accept'))
      OR (protocol = 'S1AP' AND message_type IN ('InitialContextSetup', '9')), false)""")


def handover_messages() -> str:
    return with_packets("""
SELECT packet_number, timestamp_iso, protocol, message_type, direction,
  CASE WHEN protocol = 'X2AP' THEN 'X2' WHEN protocol = 'S1AP' THEN 'S1' ELSE 'RRC' END AS scope,
  message_type LIKE '%Failure%' AS is_failure
FROM packets
WHERE (protocol IN ('S1AP', 'X2AP') AND (message_type LIKE '%andover%' OR message_type LIKE '%HO%'))
   OR (protocol = 'RRC' AND message_type IN ('mobilityFromEUTRACommand', 'rrcConnectionReconfiguration'))""")


def measurement_reports() -> str:
    hk = has_key("contains(k, 'rsrpResult') OR contains(k, 'rsrqResult')")
    return with_packets(f"""
SELECT packet_number, timestamp_iso, message_type, protocol_fields_json FROM pm
WHERE protocol = 'RRC' AND message_type = 'measurementReport' AND {hk}""")
