"""DuckDB oracle texts for the ingest round trips and enrichment (A, B)."""

from __future__ import annotations

from sigtrace.functions import codes
from sigtrace.oracle import with_packets

CORE = "packet_number, timestamp, timestamp_iso, length, source_ip, destination_ip"


def ingest_jsonl() -> str:
    return with_packets(f"\nSELECT {CORE}, CAST(cardinality(m) AS INTEGER) AS n_fields, m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_id FROM pm")


def ingest_pdml() -> str:
    return with_packets("""
SELECT packet_number, timestamp, length, CAST(cardinality(m) + 3 AS INTEGER) AS n_fields,
       m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_id, m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS enb_ue_id FROM pm""")


def normalize_packets() -> str:
    return with_packets("""
SELECT packet_number, timestamp, strftime(timestamp_hour, '%Y-%m-%d %H:%M:%S') AS hour,
       m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_ngap_id, m['ngap.ngap.AMF_UE_NGAP_ID'] AS amf_ue_ngap_id,
       m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS enb_ue_s1ap_id, m['rlc_lte.rlc-lte.ueid'] AS rlc_ueid FROM pm""")


def load_packets() -> str:
    return with_packets("""
SELECT packet_number, timestamp, strftime(timestamp_hour, '%Y-%m-%d') AS capture_date,
       m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_ngap_id, m['s1ap.s1ap.ENB_UE_S1AP_ID'] AS enb_ue_s1ap_id FROM pm""")


def write_packets() -> str:
    return with_packets("""
SELECT strftime(timestamp_hour, '%Y-%m-%d') AS capture_date, 'events' AS capture, count(*) AS rows, min(packet_number) AS first_packet,
       max(packet_number) AS last_packet, (SELECT count(*) FROM pm) AS rows_in_files FROM pm GROUP BY 1""")


def dataset_stats() -> str:
    return "SELECT count(*) AS rows, (SELECT count(*)::INT FROM (DESCRIBE events)) AS columns, true AS sized FROM events"


def parse_run_summary() -> str:
    return with_packets("""
SELECT 'events' AS capture, count(*) AS stored, count(*) FILTER (WHERE packet_number % 97 = 0) AS rejected, count(*) AS packets,
       count(*) FILTER (WHERE packet_number % 97 = 0) AS malformed, true AS written FROM pm""")


def filter_by_protocol_stack() -> str:
    return with_packets(""",
pre AS (SELECT packet_number, list_transform(map_keys(m), lambda k: replace(split_part(k, '.', 1), '_', '-')) AS p FROM pm),
st AS (SELECT packet_number, list_filter(p, lambda x, i: list_position(p, x) = i) AS stack FROM pre)
SELECT packet_number, array_to_string(stack, ',') AS stack FROM st
WHERE list_has_any(stack, ['s1ap', 'x2ap', 'lte_rrc', 'ngap', 'f1ap', 'nr-rrc'])""")


def decode_procedure() -> str:
    return with_packets(f""",
d AS (SELECT packet_number, CASE WHEN m['s1ap.s1ap.procedureCode'] IS NOT NULL THEN 'S1AP' ELSE 'NGAP' END AS family,
             coalesce(m['s1ap.s1ap.procedureCode'], m['ngap.ngap.procedureCode']) AS code
      FROM pm WHERE m['s1ap.s1ap.procedureCode'] IS NOT NULL OR m['ngap.ngap.procedureCode'] IS NOT NULL)
SELECT d.packet_number, d.family, d.code, coalesce(dim_procedure.name, d.code) AS name
FROM d LEFT JOIN {codes.DIM_PROCEDURE.sql()} ON dim_procedure.protocol = d.family AND dim_procedure.code = d.code""")


def decode_nas_5gs() -> str:
    return with_packets(f""",
d AS (SELECT packet_number, m['ngap.nas-5gs.mm.message_type'] AS raw_code,
             CASE WHEN starts_with(lower(m['ngap.nas-5gs.mm.message_type']), '0x')
                  THEN CAST(CAST(m['ngap.nas-5gs.mm.message_type'] AS BIGINT) AS VARCHAR)
                  ELSE m['ngap.nas-5gs.mm.message_type'] END AS code
      FROM pm WHERE m['ngap.nas-5gs.mm.message_type'] IS NOT NULL)
SELECT d.packet_number, d.raw_code, d.code, coalesce(dim_nas.name, d.code) AS name
FROM d LEFT JOIN {codes.DIM_NAS.sql()} ON dim_nas.kind = 'MM' AND dim_nas.code = d.code""")


def flatten_fields() -> str:
    return with_packets("""
SELECT packet_number, CAST(cardinality(m) AS INTEGER) AS n_fields, map_keys(m)[1] AS first_key,
       m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_id FROM pm""")


STACK_CTE = """,
pre AS (SELECT packet_number, m, list_transform(map_keys(m), lambda k: replace(split_part(k, '.', 1), '_', '-')) AS p FROM pm),
st AS (SELECT packet_number, m, list_filter(p, lambda x, i: list_position(p, x) = i) AS stack FROM pre)"""


INTERFACE = """CASE WHEN list_contains(stack, 'rrc') OR list_contains(stack, 'rlc') THEN 'Uu'
  WHEN list_contains(stack, 's1ap') THEN 'S1-MME' WHEN list_contains(stack, 'x2ap') THEN 'X2'
  WHEN list_contains(stack, 'ngap') THEN 'N2' WHEN list_contains(stack, 'nas-5gs') THEN 'N1'
  WHEN list_contains(stack, 'http2') THEN 'SBI' END"""


def extract_interface() -> str:
    return with_packets(STACK_CTE + f"\nSELECT packet_number, {INTERFACE} AS interface FROM st")


def _protocol_expr() -> str:
    order = ["rrc", "nas-5gs", "nas-eps", "s1ap", "x2ap", "ngap", "gtpv2", "diameter"]
    rrc_extra = ("len(list_filter(map_keys(m), lambda k: split_part(k, '.', 1) = 'rlc_lte' "
                 "AND (starts_with(substr(k, 9), 'lte-rrc.') OR starts_with(substr(k, 9), 'nr-rrc.')))) > 0")
    whens = []
    for p in order:
        cond = f"len(list_filter(stack, lambda x: contains(lower(x), '{p}'))) > 0"
        if p == "rrc":
            cond = f"({cond} OR {rrc_extra})"
        whens.append(f"WHEN {cond} THEN '{p.upper().replace('-', '_')}'")
    return f"CASE {' '.join(whens)} END"


def extract_protocol() -> str:
    return with_packets(STACK_CTE + f"\nSELECT packet_number, {_protocol_expr()} AS protocol FROM st")


# --- enrichment over layers rebuilt from the flat map (independent SQL statement of B3-B7) --------
# One row per (packet, layer) with the layer's own field map; per-packet answers are the
# first qualifying layer in stack order (arg_min over the layer position).
def _fm(p: str) -> str:
    return (f"map_from_entries(list_transform(list_filter(map_entries(m), lambda e: split_part(e.key, '.', 1) = {p}), "
            f"lambda e: {{'key': substr(e.key, length({p}) + 2), 'value': e.value}}))")


def _nz(x: str) -> str:
    return f"nullif({x}, '')"


def _decode(table: dict, x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"coalesce(CASE {x} {cases} END, {x})"


PREFIXES = ("list_filter(list_transform(map_keys(m), lambda k: split_part(k, '.', 1)), lambda x, i: "
            "list_position(list_transform(map_keys(m), lambda k: split_part(k, '.', 1)), x) = i)")


def _layer_mt() -> str:
    from sigtrace.operators.enrich import MESSAGE_FIELDS, RRC_CONTAINERS

    parts = []
    for family, fields in MESSAGE_FIELDS:
        for f in fields:
            v = _nz(f"F['{f}']")
            if family == "s1ap":
                v = _decode(codes.S1AP_PROCEDURES, v)
            elif family == "ngap":
                v = _decode(codes.NGAP_PROCEDURES, v)
            parts.append(f"CASE WHEN contains(lower(L), '{family}') THEN {v} END")
    cont = ", ".join(f"'{c}'" for c in RRC_CONTAINERS)
    rrc = ("list_filter(list_transform(list_filter(map_keys(F), lambda k: (starts_with(k, 'lte-rrc.') OR starts_with(k, 'nr-rrc.')) "
           "AND ends_with(k, '_element') AND len(string_split(k, '.')) = 2), lambda k: replace(split_part(k, '.', 2), '_element', '')), "
           f"lambda n: NOT list_contains([{cont}], n))[1]")
    parts.append(f"CASE WHEN L = 'rlc-lte' THEN {rrc} END")
    return "coalesce(" + ", ".join(parts) + ")"


def _layers_ctes() -> str:
    from sigtrace.operators.enrich import DOWNLINK_NAS, UPLINK_NAS

    code = "CASE WHEN starts_with(lower(mt), '0x') THEN CAST(CAST(mt AS BIGINT) AS VARCHAR) ELSE mt END"
    up = " OR ".join(f"contains(lower(named), '{w}')" for w in UPLINK_NAS)
    down = " OR ".join(f"contains(lower(named), '{w}')" for w in DOWNLINK_NAS)

    def keys(ks):
        return "coalesce(" + ", ".join(_nz(f"F['{k}']") for k in ks) + ")"

    return f""",
lay0 AS (SELECT packet_number, m, unnest({PREFIXES}) AS p, unnest(range(1, len({PREFIXES}) + 1)) AS pos FROM pm),
lay AS (SELECT packet_number, pos, replace(p, '_', '-') AS L, {_fm('p')} AS F FROM lay0),
lay1 AS (SELECT *, {_layer_mt()} AS mt,
  {keys(["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID"])} AS v_ran,
  {keys(["s1ap.ENB_UE_S1AP_ID", "s1ap.s1ap.ENB_UE_S1AP_ID", "s1ap.MME_UE_S1AP_ID", "s1ap.s1ap.MME_UE_S1AP_ID"])} AS v_enb,
  {keys(["nas_eps.emm.imsi", "nas_5gs.mm.imsi", "e212.imsi"])} AS v_imsi,
  {keys(["nas_eps.emm.guti", "nas_5gs.mm.5g_guti"])} AS v_guti,
  {keys(["nas_eps.emm.m_tmsi", "gsm_a.tmsi"])} AS v_tmsi,
  {keys(["rrc.c_rnti", "lte-rrc.c_rnti", "nr-rrc.c_rnti"])} AS v_rnti,
  {_nz("F['rrc.direction']")} AS rrc_dir FROM lay),
lay2 AS (SELECT *, CASE WHEN contains(lower(L), 'nas-5gs') THEN CASE WHEN mt IS NOT NULL THEN {_decode(codes.NAS_5GS_MM, code)} END
                     ELSE mt END AS named FROM lay1),
lay3 AS (SELECT *, CASE WHEN {up} THEN 'UL' WHEN {down} THEN 'DL' END AS nas_dir FROM lay2),
per AS (SELECT packet_number,
  arg_min(mt, pos) FILTER (WHERE mt IS NOT NULL) AS message_type,
  coalesce(arg_min(v_ran, pos) FILTER (WHERE L = 'ngap' AND v_ran IS NOT NULL),
           arg_min(v_enb, pos) FILTER (WHERE L = 's1ap' AND v_enb IS NOT NULL),
           'IMSI:' || arg_min(v_imsi, pos) FILTER (WHERE L IN ('nas-eps', 'nas-5gs', 'gsm_a.gm') AND v_imsi IS NOT NULL),
           'GUTI:' || arg_min(v_guti, pos) FILTER (WHERE L IN ('nas-eps', 'nas-5gs') AND v_guti IS NOT NULL),
           'TMSI:' || arg_min(v_tmsi, pos) FILTER (WHERE L IN ('nas-eps', 'gsm_a.gm') AND v_tmsi IS NOT NULL),
           'RNTI:' || arg_min(v_rnti, pos) FILTER (WHERE L = 'rrc' AND v_rnti IS NOT NULL)) AS ue_id,
  arg_min(rrc_dir, pos) FILTER (WHERE contains(lower(L), 'rrc') AND rrc_dir IS NOT NULL) AS rrc_dir,
  arg_min(nas_dir, pos) FILTER (WHERE contains(lower(L), 'nas') AND nas_dir IS NOT NULL) AS nas_dir
  FROM lay3 GROUP BY packet_number),
enr AS (SELECT pm.packet_number, per.message_type, per.ue_id,
  coalesce(CASE WHEN contains(lower(rrc_dir), 'uplink') OR contains(lower(rrc_dir), 'ul') THEN 'UL'
                WHEN contains(lower(rrc_dir), 'downlink') OR contains(lower(rrc_dir), 'dl') THEN 'DL' END, nas_dir) AS direction
  FROM pm LEFT JOIN per USING (packet_number))"""


def extract_ue_id() -> str:
    return with_packets(_layers_ctes() + "\nSELECT packet_number, ue_id FROM enr")


def extract_message_type() -> str:
    return with_packets(_layers_ctes() + "\nSELECT packet_number, message_type FROM enr")


def extract_direction() -> str:
    return with_packets(_layers_ctes() + "\nSELECT packet_number, direction FROM enr")


def enrich_packets() -> str:
    return with_packets(_layers_ctes() + STACK_CTE + f"""
SELECT enr.packet_number, ue_id, message_type, {_protocol_expr()} AS protocol, {INTERFACE} AS interface, direction
FROM enr JOIN st USING (packet_number)""")


def pdml_field_context() -> str:
    return with_packets("""
SELECT packet_number, k AS field FROM (SELECT packet_number, unnest(map_keys(m)) AS k FROM pm) WHERE contains(k, 'Result')""")


def ingest_stream() -> str:
    return with_packets("\nSELECT packet_number, timestamp, m['ngap.ngap.RAN_UE_NGAP_ID'] AS ran_ue_ngap_id FROM pm")


def write_results() -> str:
    from sigtrace.oracle.release_sql import EVENTS_CTE

    return with_packets(EVENTS_CTE + """
SELECT CAST(packet_number AS VARCHAR) AS packet_number, ran_ue_id, amf_ue_id, procedure_code, procedure_name, cause_raw,
       release_type, cause_category FROM ev""")


def protocol_layer() -> str:
    return with_packets("""
SELECT packet_number,
  CAST(CASE WHEN len(list_filter(map_keys(m), lambda k: split_part(k, '.', 1) = 'ngap')) > 0
            THEN len(list_filter(map_keys(m), lambda k: split_part(k, '.', 1) = 'ngap')) END AS DOUBLE) AS ngap_fields,
  len(list_filter(map_keys(m), lambda k: split_part(k, '.', 1) = 'sctp')) > 0 AS has_sctp,
  coalesce(m['ngap.ngap.procedureCode'], '-') AS procedure_code FROM pm""")
