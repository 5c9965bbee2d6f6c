"""Call-flow tracing.

A 5G UE session is keyed by its AMF UE NGAP id: the session of AMF id ``A`` is
every packet carrying ``A`` plus every packet carrying a RAN UE NGAP id that was
seen together with ``A``.  The reference starts from one RAN id; its session is the
union of the sessions of that RAN id's AMF ids (:func:`ue_session`), so the
all-UE form never pairs RAN ids with each other.  Ordered per-session logic
(id changes, phases, steps) runs through the chunked scans of
:mod:`sigtrace.plans.ordered` / :mod:`sigtrace.plans.fsm`, so one huge session is
split across many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrace.functions import codes
from sigtrace.functions.fields import capture_scope, has_key, packet_key, val, with_fields
from sigtrace.functions.lookup import lookup
from sigtrace.operators.enrich import nas_code
from sigtrace.plans.fsm import fsm_scan
from sigtrace.plans.ordered import DEFAULT_CHUNK, scan, sequence

RAN = "ngap.ngap.RAN_UE_NGAP_ID"
AMF = "ngap.ngap.AMF_UE_NGAP_ID"
RAN_VARIANTS = ["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID", "RAN_UE_NGAP_ID"]


def _ids(packets: DataFrame) -> DataFrame:
    df = with_fields(packets)
    m = F.col("m")
    return df.withColumn("ran", F.nullif(val(m, RAN), F.lit(""))).withColumn("amf", F.nullif(val(m, AMF), F.lit("")))


# ---------------------------------------------------------------------------
# sessions
# ---------------------------------------------------------------------------
def session_packets(packets: DataFrame) -> DataFrame:
    """T1 (all UEs): ``session`` (AMF id) x packets of that session.

    A packet belongs to the session of its own AMF id, and to the session of every
    other AMF id its RAN id was seen with; the second part excludes the packet's own
    AMF id, so the union has no duplicates and needs no distinct (no extra shuffle).
    """
    d = _ids(packets)
    scope = capture_scope(d)  # ids are counters of their network: those of two captures have nothing to do with each other
    pairs = d.where(F.col("ran").isNotNull() & F.col("amf").isNotNull()).select(*scope, "ran", F.col("amf").alias("session")).distinct()
    by_amf = d.where(F.col("amf").isNotNull()).withColumn("session", F.col("amf"))
    by_ran = d.join(pairs, [*scope, "ran"]).where(F.col("amf").isNull() | (F.col("session") != F.col("amf")))
    return by_amf.unionByName(by_ran)


def write_sessions(packets: DataFrame, path: str) -> DataFrame:
    """Materialise :func:`session_packets` once (Parquet) and return the table, so the
    session operators below can share it (``sessions=`` argument) instead of each
    rebuilding it from the packets."""
    session_packets(packets).write.mode("overwrite").parquet(path)
    return packets.sparkSession.read.parquet(path)


def _session_keys(sp: DataFrame) -> list[str]:
    """What identifies a session: its id, within a capture where the table has several."""
    return ["capture", "session"] if "capture" in sp.columns else ["session"]


def _sessions(packets: DataFrame, sessions: DataFrame | None) -> DataFrame:
    return session_packets(packets) if sessions is None else sessions


def ue_session(packets: DataFrame, target_ran: str | DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """T1 for chosen RAN ids (literal or a DataFrame column ``value``): ``target`` x its session packets.

    The sessions of all AMF ids of the target are one: each packet is there once, under
    ``session`` = target, so T2-T6 can be given the result as ``sessions``.
    """
    d = _ids(packets)
    if isinstance(target_ran, DataFrame):
        # Any number of targets: no hint, AQE broadcasts it only if its measured size is small.
        targets = target_ran.select(F.col("value").alias("target")).distinct()
    else:
        targets = F.broadcast(d.sparkSession.range(1).select(F.lit(str(target_ran)).alias("target")))  # one row
    scope = capture_scope(d)
    amfs = (
        d.where(F.col("amf").isNotNull())
        .join(targets, d["ran"] == targets["target"])
        .select(*scope, "target", F.col("amf").alias("session"))
        .distinct()
    )
    sp = _sessions(packets, sessions)
    member = sp.join(amfs, [*scope, "session"])
    # a packet of one of the target's AMF ids is its own; others come through a RAN id, maybe of several AMF ids
    own = member.where(F.col("amf") == F.col("session"))
    others = member.where(F.col("amf").isNull() | (F.col("amf") != F.col("session"))).drop("session")
    mine = amfs.withColumnRenamed("session", "amf")
    others = others.dropDuplicates(["target", *packet_key(d)]).join(mine, [*scope, "target", "amf"], "left_anti")
    merged = own.drop("session").withColumn("own", F.lit(True)).unionByName(others.withColumn("own", F.lit(False)))
    return merged.withColumn("session", F.col("target"))


def session_summary(packets: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """T2 per session: RAN ids, messages, first / last time, PDU sessions, handover attempts,
    releases and distinct message types (counts; id lists come from :func:`ran_id_evolution`)."""
    sp = _sessions(packets, sessions)
    m = F.col("m")
    keys = _session_keys(sp)
    own = F.col("own") if "own" in sp.columns else F.col("amf") == F.col("session")  # ids and PDU sessions come from packets carrying the AMF id
    pdu_vals = F.transform(
        F.filter(F.map_entries(m), lambda e: (e["key"].contains("pDUSessionID") | e["key"].contains("PDUSessionID")) & (e["value"] != "")),
        lambda e: e["value"],
    )
    pdus = sp.where(own).select(*keys, F.explode(pdu_vals).alias("pdu")).groupBy(*keys).agg(
        F.countDistinct("pdu").alias("pdu_sessions")
    )
    main = sp.groupBy(*keys).agg(
        F.countDistinct(F.when(own, F.col("ran"))).alias("ran_ids"),
        F.count(F.lit(1)).alias("messages"),
        F.min("timestamp_iso").alias("first_time"),
        F.max("timestamp_iso").alias("last_time"),
        F.count_if((F.col("message_type") == "HandoverPreparation") & F.coalesce(m[ "ngap.ngap.HandoverRequired_element"].isNotNull(), F.lit(False))).alias("handover_attempts"),
        F.count_if(F.coalesce(F.col("message_type").contains("Release"), F.lit(False))).alias("releases"),
        F.countDistinct("message_type").alias("message_types"),
    )
    return main.join(pdus, keys, "left").select(
        *keys, "ran_ids", "messages", "first_time", "last_time",
        F.coalesce("pdu_sessions", F.lit(0)).cast("bigint").alias("pdu_sessions"),
        "handover_attempts", "releases", "message_types",
    )


def session_ids(packets: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """T2 id lists in long form: (session, kind, id) with kind ``ran``, ``amf`` or ``pdu_session``.

    RAN ids and PDU sessions come from packets carrying the session's AMF id, AMF ids from all its packets.
    """
    sp = _sessions(packets, sessions)
    own = F.col("own") if "own" in sp.columns else F.coalesce(F.col("amf") == F.col("session"), F.lit(False))
    held = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("id")))
    pdus = F.transform(
        F.filter(F.map_entries("m"), lambda e: (e["key"].contains("pDUSessionID") | e["key"].contains("PDUSessionID")) & (e["value"] != "")),
        lambda e: e["value"],
    )
    none = F.array().cast("array<string>")
    ids = F.concat(
        held("ran", F.when(own, F.array_compact(F.array("ran"))).otherwise(none)),
        held("amf", F.array_compact(F.array("amf"))),
        held("pdu_session", F.when(own, pdus).otherwise(none)),
    )
    return sp.select(*_session_keys(sp), F.explode(ids).alias("x")).select(*_session_keys(sp), "x.kind", "x.id").distinct()


# ---------------------------------------------------------------------------
# RAN id evolution
# ---------------------------------------------------------------------------
def ran_id_evolution(packets: DataFrame, sessions: DataFrame | None = None, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """The first RAN id of each session and every later change, in packet order."""
    sp = _sessions(packets, sessions).where(F.col("ran").isNotNull())
    keys = _session_keys(sp)
    seq = sequence(sp, keys, "packet_number", lag_cols=["ran"], chunk_size=chunk_size)
    ch = seq.where(F.col("prev_ran").isNull() | (F.col("prev_ran") != F.col("ran")))
    reason = F.coalesce(lookup(codes.RAN_CHANGE_REASONS, F.col("message_type")), F.lit(codes.RAN_CHANGE_DEFAULT_REASON))
    return ch.select(
        *keys,
        "packet_number",
        F.col("prev_ran").alias("previous_ran"),
        F.col("ran").alias("new_ran"),
        "message_type",
        F.substring("timestamp_iso", 1, 19).alias("time"),
        F.when(F.col("prev_ran").isNotNull(), reason).alias("reason"),
    )


# ---------------------------------------------------------------------------
# Phases and steps
# ---------------------------------------------------------------------------
# FIXED VALUES: phase names of the call-flow state machine.
PHASES = ["Registration and Attach", "Handover Procedure", "Path Switch", "PDU Session Establishment"]
LEN_CAP = 6  # only "more than five messages" matters, so the length saturates at 6
PHASE_STATES = [(p, n) for p in range(len(PHASES)) for n in range(LEN_CAP + 1)]


def phase_symbol(message_type: Column) -> Column:
    """The message classes the state machine distinguishes (computed in Spark)."""
    mt = F.coalesce(message_type, F.lit(""))
    return (
        F.when(mt == "InitialUEMessage", "I")
        .when(mt.contains("HandoverPreparation"), "H")
        .when(mt == "PathSwitchRequest", "P")
        .when(mt.contains("PDUSessionResourceSetup"), "D")
        .otherwise("O")
    )


def phase_step(state, symbol: str):
    """One message of the phase state machine: ``(phase, length) -> (phase', length'), opened``."""
    phase, n = state
    if symbol == "I" and n > 0:
        return (0, 1), True
    if symbol == "H" and "Handover" not in PHASES[phase]:
        return (1, 1), True
    if symbol == "P":  # always opens: the name test never matches (K20)
        return (2, 1), True
    if symbol == "D" and n > 5:
        return (3, 1), True
    return (phase, min(n + 1, LEN_CAP)), False


def _phase_name(idx: Column) -> Column:
    expr = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(PHASES))):
        expr = F.when(idx == i, F.lit(name)).otherwise(expr)
    return expr


def _phase_states(sp: DataFrame, chunk_size: int = DEFAULT_CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Phase number / name per session packet from the chunked state machine, with the columns ``keep``."""
    keys = _session_keys(sp)
    sp = sp.withColumn("_key", F.to_json(F.struct(*keys)))
    st = fsm_scan(sp, "_key", "packet_number", phase_symbol(F.col("message_type")), PHASE_STATES, (0, 0), phase_step, chunk_size, keep)
    idx = F.floor(F.col("state_id") / (LEN_CAP + 1)).cast("int")  # state id = phase * 7 + length
    parts = F.from_json("_key", ", ".join(f"{k} string" for k in keys))
    return st.select(
        *[parts[k].alias(k) for k in keys], "packet_number", *keep, F.col("segment").alias("phase_no"), idx.alias("phase_idx"),
        _phase_name(idx).alias("phase"), "opened", "first",
    )


def session_phase_rows(packets: DataFrame, sessions: DataFrame | None = None, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Per session packet: phase number and phase name (state machine over packet order) beside the packet's columns."""
    sp = _sessions(packets, sessions)
    own = tuple(c for c in sp.columns if c not in (*_session_keys(sp), "packet_number"))
    return _phase_states(sp, chunk_size, own)


def session_phases(packets: DataFrame, sessions: DataFrame | None = None, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """T4: phases per session: number, name, first / last packet, message count.

    A session whose first message opens a phase starts with an empty
    'Registration and Attach' phase (start = end = first packet, 0 messages); that
    row is emitted by the same single aggregation (a zero-weight companion row).
    """
    rows = _phase_states(_sessions(packets, sessions), chunk_size)
    real = F.struct(F.col("phase_no").alias("p"), F.col("phase_idx").alias("i"), F.lit(1).alias("w"))
    empty = F.struct(F.lit(1).cast("long").alias("p"), F.lit(0).alias("i"), F.lit(0).alias("w"))
    parts = F.when(F.col("first") & F.col("opened"), F.array(real, empty)).otherwise(F.array(real))
    keys = _session_keys(rows)
    x = rows.select(*keys, "packet_number", F.explode(parts).alias("x"))
    # numeric buffers only, so Spark plans a hash aggregate (no sort)
    agg = x.groupBy(*keys, F.col("x.p").alias("phase_no")).agg(
        F.min("x.i").alias("_i"),  # constant within a phase
        F.min("packet_number").alias("start_packet"),
        F.max("packet_number").alias("end_packet"),
        F.sum("x.w").cast("long").alias("messages"),
    )
    return agg.select(*keys, "phase_no", _phase_name(F.col("_i")).alias("phase"), "start_packet", "end_packet", "messages")


def session_message_counts(packets: DataFrame, top: int = 10, sessions: DataFrame | None = None) -> DataFrame:
    """T5: top message types per session by count (ties by name)."""
    sp = _sessions(packets, sessions).where(F.col("message_type").isNotNull())
    keys = _session_keys(sp)
    c = sp.groupBy(*keys, "message_type").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), F.asc("message_type"))
    return c.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def step_cause(m: Column) -> Column:
    """``radioNetwork: <name>`` for radioNetwork causes (5 named, else ``code-<n>``)."""
    grp = val(m, "ngap.ngap.Cause")
    gname = F.coalesce(lookup(codes.CAUSE_GROUPS, grp), F.concat(F.lit("category-"), grp))
    cv = m[F.concat(F.lit("ngap.ngap."), gname)]
    name = F.coalesce(lookup(codes.STEP_CAUSE_NAMES, cv), F.concat(F.lit("code-"), cv))
    return F.when(grp.isNotNull() & (gname == "radioNetwork") & cv.isNotNull(), F.concat(gname, F.lit(": "), name))


def session_steps(packets: DataFrame, sessions: DataFrame | None = None, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Every message of every phase with its index, sub-message tag, ids and cause.

    What a step shows is worked out before the state machine and goes along, so the packets are not joined again.
    """
    sp = _sessions(packets, sessions)
    keys = _session_keys(sp)
    m = F.col("m")
    sub = (
        F.when(m["ngap.ngap.HandoverRequired_element"].isNotNull(), "HandoverRequired")
        .when(m["ngap.ngap.HandoverCommand_element"].isNotNull(), "HandoverCommand")
        .when(m["ngap.ngap.HandoverRequest_element"].isNotNull(), "HandoverRequest")
    )
    shown = ("time", "message_type", "sub_message", "ran_ue_id", "amf_ue_id", "cause")
    sp = sp.select(
        *keys, "packet_number", F.substring("timestamp_iso", 1, 19).alias("time"), "message_type", sub.alias("sub_message"),
        F.coalesce(m[RAN], F.lit("-")).alias("ran_ue_id"), F.coalesce(m[AMF], F.lit("-")).alias("amf_ue_id"), step_cause(m).alias("cause"),
    )
    rows = _phase_states(sp, chunk_size, shown)
    rows = sequence(rows, [*keys, "phase_no"], "packet_number", seq_col="index_in_phase", chunk_size=chunk_size)
    return rows.select(*keys, "phase_no", "phase", "index_in_phase", "packet_number", *shown)


# ---------------------------------------------------------------------------
# Enriched call flow per RAN id
# ---------------------------------------------------------------------------
def enriched_call_flow(packets: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """T7 for every RAN id: steps with time, delta, procedure, ids, PDU, UE IP, flow direction, notes."""
    df = with_fields(packets)
    m = F.col("m")
    anchor = F.array_distinct(F.filter(F.array(*[val(m, k) for k in RAN_VARIANTS]), lambda x: x.isNotNull()))
    scope = capture_scope(df)
    base = df.select(*scope, "packet_number", "timestamp", "m", F.explode(anchor).alias("ue"))
    proc = m["ngap.ngap.procedureCode"]
    pdu = F.coalesce(F.nullif(m["ngap.ngap.pDUSessionID"], F.lit("")), F.nullif(m["ngap.nas-5gs.pdu_session_id"], F.lit("")))
    ue_ip = F.coalesce(
        F.nullif(m["ngap.nas-5gs.sm.pdu_addr_inf_ipv4"], F.lit("")), F.nullif(m["ngap.nas-5gs.sm.pdu_addr_inf_ipv6"], F.lit(""))
    )
    srcp = F.coalesce(F.nullif(m["sctp.sctp.srcport"], F.lit("")), F.nullif(m["sctp.srcport"], F.lit("")))
    dstp = F.coalesce(F.nullif(m["sctp.sctp.dstport"], F.lit("")), F.nullif(m["sctp.dstport"], F.lit("")))
    flow_dir = (
        F.when(m["ngap.ngap.DownlinkNASTransport_element"].isNotNull() | F.coalesce(proc == "4", F.lit(False)), "DOWNLINK")
        .when(m["ngap.ngap.UplinkNASTransport_element"].isNotNull() | F.coalesce(proc == "46", F.lit(False)), "UPLINK")
        .when(F.coalesce(srcp == "38412", F.lit(False)), "DOWNLINK")
        .when(F.coalesce(dstp == "38412", F.lit(False)), "UPLINK")
    )
    outcome = (
        F.when(has_key(m, lambda k: k.endswith("initiatingMessage_element")), "initiating")
        .when(has_key(m, lambda k: k.endswith("successfulOutcome_element")), "successfulOutcome")
        .when(has_key(m, lambda k: k.endswith("unsuccessfulOutcome_element")), "unsuccessfulOutcome")
    )
    mm = F.coalesce(F.nullif(m["ngap.nas-5gs.mm.message_type"], F.lit("")), F.nullif(m["nas-5gs.mm.message_type"], F.lit("")))
    sm = F.coalesce(F.nullif(m["ngap.nas-5gs.sm.message_type"], F.lit("")), F.nullif(m["nas-5gs.sm.message_type"], F.lit("")))
    nas_name = F.when(mm.isNotNull(), F.coalesce(lookup(codes.NAS_5GS_MM, nas_code(mm)), nas_code(mm))).when(
        sm.isNotNull(), F.coalesce(lookup(codes.NAS_5GS_SM, nas_code(sm)), nas_code(sm))
    )
    nas_note = F.when(F.coalesce(proc.isin("4", "46"), F.lit(False)) & nas_name.isNotNull(), F.concat(F.lit("NAS: "), nas_name))
    notes = F.concat_ws(
        ", ", nas_note, F.concat(F.lit("PDU="), pdu), F.concat(F.lit("UE_IP="), ue_ip), outcome
    )
    known = F.coalesce(lookup(codes.NGAP_PROCEDURES, proc).isNotNull(), F.lit(False))
    include = known | pdu.isNotNull() | ue_ip.isNotNull() | F.coalesce(proc == "4", F.lit(False))
    ts_ms = F.floor(F.round(F.col("timestamp") * 1000000) / 1000).cast("long")
    # one pass: the time before counts every packet of the id, the step those included
    base = scan(base.withColumn("_in", F.when(include, 1).otherwise(0)), [*scope, "ue"], "packet_number", lag={"prev_timestamp": "timestamp"}, running={"step": "_in"}, chunk_rows=chunk_size)
    return base.where("_in = 1").select(
        *scope,
        F.col("ue").alias("ran_target"),
        "packet_number",
        F.concat(F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("iso_time"),
        # whole milliseconds, truncated; DOUBLE because the first step has none (NULL)
        ((F.col("timestamp") - F.col("prev_timestamp")) * 1000).cast("long").cast("double").alias("delta_ms"),
        proc.alias("procedure_code"),
        F.coalesce(lookup(codes.NGAP_PROCEDURES, proc), F.when(F.length(F.coalesce(proc, F.lit(""))) > 0, F.concat(F.lit("PROC_"), proc)), F.lit("UNKNOWN")).alias("procedure_name"),
        m[AMF].alias("amf_ue_id"),
        m[RAN].alias("ran_ue_id"),
        pdu.alias("pdu_session_id"),
        ue_ip.alias("ue_ip"),
        flow_dir.alias("flow_dir"),
        F.nullif(notes, F.lit("")).alias("notes"),
        "step",
    )


# ---------------------------------------------------------------------------
# LTE handover trace and call flow
# ---------------------------------------------------------------------------
HO_TRACE_KEYS = ["s1ap.s1ap.ENB_UE_S1AP_ID", "s1ap.s1ap.MME_UE_S1AP_ID", "x2ap.x2ap.Old_ENB_UE_X2AP_ID", "x2ap.x2ap.New_ENB_UE_X2AP_ID"]


def handover_trace(packets: DataFrame) -> DataFrame:
    """T9 (all UEs): packets of each UE id matched on S1AP ENB/MME and X2AP old/new ids only."""
    df = with_fields(packets)
    m = F.col("m")
    ids = F.array_distinct(F.filter(F.array(*[val(m, k) for k in HO_TRACE_KEYS]), lambda x: x.isNotNull()))
    return df.select(F.explode(ids).alias("trace_ue"), *[c for c in df.columns])


# FIXED VALUES: handover phase patterns per handover type, tested in this order.
X2_PATTERNS = [
    ("PREPARATION", ["handoverrequest", "handoverpreparation"]),
    ("EXECUTION", ["snstatustransfer", "pathswitch"]),
    ("COMPLETION", ["uecontextrelease", "handoverrequestacknowledge"]),
    ("FAILURE", ["handoverpreparationfailure", "handoverfailure"]),
]
S1_PATTERNS = [
    ("PREPARATION", ["handoverrequired", "handoverrequest"]),
    ("EXECUTION", ["handovercommand", "mobilityfromeut"]),
    ("COMPLETION", ["handovernotify", "uecontextrelease"]),
    ("FAILURE", ["handoverfailure", "handoverpreparationfailure"]),
]


def _phase_of(patterns, mt: Column) -> Column:
    expr = None
    for phase, pats in reversed(patterns):
        cond = F.lit(False)
        for p in pats:
            cond = cond | mt.contains(p)
        expr = F.when(cond, phase) if expr is None else F.when(cond, phase).otherwise(expr)
    return expr


def handover_flow(packets: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Handover trace rows annotated with step, flow marker, specific message, ids,
    sticky handover type (X2/S1) and sticky phase."""
    tr = handover_trace(packets)
    m = F.col("m")
    mt = F.lower(F.coalesce(F.col("message_type"), F.lit("")))
    ho_set = F.when(F.col("protocol") == "X2AP", "X2").when((F.col("protocol") == "S1AP") & mt.contains("handover"), "S1")
    scope = capture_scope(tr)
    rrc = F.when((F.col("protocol") == "RRC") & (mt.contains("mobility") | mt.contains("reconfiguration")), "EXECUTION")
    phases = {"X2": F.coalesce(rrc, _phase_of(X2_PATTERNS, mt)), "S1": F.coalesce(rrc, _phase_of(S1_PATTERNS, mt)), None: rrc}
    tr = scan(tr, [*scope, "trace_ue"], "packet_number", seq="step", last_value={"ho_type": ho_set}, switched={"phase": ("ho_type", phases)}, last="is_last", chunk_rows=chunk_size)
    spec = F.get(
        F.filter(
            F.transform(
                F.filter(
                    F.map_keys(m),
                    lambda k: ((F.col("protocol") == "S1AP") & k.contains("s1ap.s1ap.") & k.contains("_element"))
                    | ((F.col("protocol") == "X2AP") & k.contains("x2ap.x2ap.") & k.contains("_element")),
                ),
                lambda k: F.replace(F.replace(F.replace(k, F.lit("s1ap.s1ap."), F.lit("")), F.lit("x2ap.x2ap."), F.lit("")), F.lit("_element"), F.lit("")),
            ),
            lambda n: (n != "") & F.lower(n).contains("handover"),
        ),
        0,
    )
    flow = (
        F.when(F.col("step") == 1, "START")
        .when(mt.contains("failure"), "FAIL")
        .when(mt.contains("acknowledge") | mt.contains("complete"), "ACK")
        .when(mt.contains("notify"), "NOTIFY")
        .when(mt.contains("release") & F.col("is_last"), "END")
        .when(mt.contains("release"), "RELEASE")
        .otherwise("->")
    )
    enb = F.coalesce(
        F.nullif(m["s1ap.s1ap.ENB_UE_S1AP_ID"], F.lit("")),
        F.nullif(m["x2ap.x2ap.Old_ENB_UE_X2AP_ID"], F.lit("")),
        F.nullif(m["x2ap.x2ap.New_ENB_UE_X2AP_ID"], F.lit("")),
        F.nullif(m["rlc_lte.rlc-lte.ueid"], F.lit("")),
    )
    return tr.select(
        *scope, "trace_ue", "step", flow.alias("flow"), "packet_number", "timestamp_iso", "protocol",
        F.coalesce(spec, F.col("message_type")).alias("message_type"),
        F.coalesce(enb, F.lit("-")).alias("enb_ue_id"),
        F.coalesce(F.nullif(m["s1ap.s1ap.MME_UE_S1AP_ID"], F.lit("")), F.lit("-")).alias("mme_ue_id"),
        F.coalesce(F.nullif(F.col("direction"), F.lit("")), F.lit("-")).alias("direction"),
        F.coalesce(F.nullif(F.col("interface"), F.lit("")), F.lit("-")).alias("interface"),
        F.coalesce("phase", F.lit("UNKNOWN")).alias("phase"),
        F.coalesce("ho_type", F.lit("UNKNOWN")).alias("ho_type"),
    )


LTE_TRACE_KEYS = {
    "rlc_ueid": ["rlc_lte.rlc-lte.ueid"],
    "m_tmsi": ["s1ap.nas-eps.emm.m_tmsi", "nas_eps.nas-eps.emm.m_tmsi", "rlc_lte.nas-eps.emm.m_tmsi"],
    "mme_ue_s1ap_id": ["s1ap.s1ap.MME_UE_S1AP_ID"],
}


def lte_call_flow(packets: DataFrame, id_type: str = "rlc_ueid") -> DataFrame:
    """T10 (all ids of a kind): 4G trace rows; ``summary`` is the reference's 200-character
    preview of the fields, ``protocol_fields_json`` the whole text."""
    df = with_fields(packets)
    m = F.col("m")
    ids = F.array_distinct(F.filter(F.array(*[val(m, k) for k in LTE_TRACE_KEYS[id_type]]), lambda x: x.isNotNull()))
    return df.select(
        *capture_scope(df), F.explode(ids).alias("trace_id"), "packet_number", "timestamp_iso", "protocol", "message_type",
        "direction", "interface", F.substring("protocol_fields_json", 1, 200).alias("summary"), "protocol_fields_json",
    )


# ---------------------------------------------------------------------------
# LTE procedure step tables
# ---------------------------------------------------------------------------
# FIXED VALUES: LTE procedure step tables (procedure, step, message, direction, protocol, match kind, value).
PROCEDURE_STEPS = [
    ("attach_procedure", 1, "RRC Connection Request", "UL", "RRC", "identifier", "rrcConnectionRequest"),
    ("attach_procedure", 2, "RRC Connection Setup", "DL", "RRC", "identifier", "rrcConnectionSetup"),
    ("attach_procedure", 3, "RRC Connection Setup Complete", "UL", "RRC", "identifier", "rrcConnectionSetupComplete"),
    ("attach_procedure", 4, "Attach Request", "UL", "NAS_EPS", "message_type", "65"),
    ("attach_procedure", 5, "Authentication Request", "DL", "NAS_EPS", "message_type", "82"),
    ("attach_procedure", 6, "Authentication Response", "UL", "NAS_EPS", "message_type", "83"),
    ("attach_procedure", 7, "Security Mode Command", "DL", "NAS_EPS", "message_type", "93"),
    ("attach_procedure", 8, "Security Mode Complete", "UL", "NAS_EPS", "message_type", "94"),
    ("attach_procedure", 9, "Initial Context Setup Request", "DL", "S1AP", "message_type", "9"),
    ("attach_procedure", 10, "Initial Context Setup Response", "UL", "S1AP", "message_type", "10"),
    ("attach_procedure", 11, "Attach Accept", "DL", "NAS_EPS", "message_type", "66"),
    ("attach_procedure", 12, "Attach Complete", "UL", "NAS_EPS", "message_type", "68"),
    ("detach_procedure", 1, "Detach Request", "UL/DL", "NAS_EPS", "message_type", "69"),
    ("detach_procedure", 2, "Detach Accept", "DL/UL", "NAS_EPS", "message_type", "70"),
    ("detach_procedure", 3, "UE Context Release Command", "DL", "S1AP", "message_type", "23"),
    ("detach_procedure", 4, "UE Context Release Complete", "UL", "S1AP", "message_type", "24"),
    ("handover_procedure", 1, "Handover Request", "Source->Target", "X2AP", "message_type", "0"),
    ("handover_procedure", 2, "Handover Request Acknowledge", "Target->Source", "X2AP", "message_type", "1"),
    ("handover_procedure", 3, "RRC Connection Reconfiguration", "DL", "RRC", "identifier", "rrcConnectionReconfiguration"),
    ("handover_procedure", 4, "RRC Connection Reconfiguration Complete", "UL", "RRC", "identifier", "rrcConnectionReconfigurationComplete"),
    ("tracking_area_update", 1, "Tracking Area Update Request", "UL", "NAS_EPS", "message_type", "72"),
    ("tracking_area_update", 2, "Tracking Area Update Accept", "DL", "NAS_EPS", "message_type", "73"),
]
DIM_PROCEDURE_STEP = codes.Dim(
    "dim_procedure_step", ("procedure", "step", "message", "direction", "protocol", "match_kind", "match_value"),
    tuple(PROCEDURE_STEPS),
)


# FIXED VALUES: fields that name an LTE UE, tried in this order, and the kind of the id.
LTE_UE_KEYS = [
    ("enb", "s1ap.s1ap.ENB_UE_S1AP_ID"),
    ("enb", "x2ap.x2ap.Old_ENB_UE_X2AP_ID"),
    ("enb", "x2ap.x2ap.New_ENB_UE_X2AP_ID"),
    ("rlc", "rlc_lte.rlc-lte.ueid"),
    ("m_tmsi", "nas_eps.nas-eps.emm.m_tmsi"),
]


def lte_ue(m: Column) -> Column:
    """``kind:id`` of the UE an LTE packet belongs to; NULL where it names none."""
    return F.coalesce(*[F.concat(F.lit(f"{kind}:"), F.nullif(val(m, key), F.lit(""))) for kind, key in LTE_UE_KEYS])


def _step_hits(df: DataFrame, *columns) -> DataFrame:
    """Packets with the procedure steps they match: same protocol and the step's code, or for RRC steps its name
    as message type or inside a field name."""
    steps = DIM_PROCEDURE_STEP.df(df.sparkSession)
    m = F.col("m")
    cond = (df["protocol"] == steps["protocol"]) & (
        ((steps["match_kind"] == "message_type") & (df["message_type"] == steps["match_value"]))
        | ((steps["match_kind"] == "identifier") & ((df["message_type"] == steps["match_value"]) | F.exists(F.map_keys(m), lambda k: k.contains(steps["match_value"]))))
    )
    return df.select("protocol", "message_type", "m", "packet_number", *columns).join(steps, cond)


def procedure_step_match(packets: DataFrame) -> DataFrame:
    """For each LTE procedure step, how many packets match it and the first one."""
    df = with_fields(packets)
    steps = DIM_PROCEDURE_STEP.df(df.sparkSession)
    hits = _step_hits(df).groupBy("procedure", "step").agg(F.count(F.lit(1)).alias("packets"), F.min("packet_number").alias("first_packet"))
    return steps.join(hits, ["procedure", "step"], "left").select(
        "procedure", "step", "message", "direction", "protocol",
        F.coalesce("packets", F.lit(0)).cast("bigint").alias("packets"),
        F.col("first_packet").cast("double").alias("first_packet"),  # NULL for unseen steps
        F.col("packets").isNotNull().alias("seen"),
    )


def ue_procedure_steps(packets: DataFrame) -> DataFrame:
    """T11 per UE: every step of each procedure that a UE has begun, with its packets, the first one and whether the
    procedure is complete.

    One aggregate per (UE, procedure) holds the bitmap of steps seen and, for each of the at most 12 steps, count and
    first packet; the steps are spread out again afterwards, without a second shuffle.
    """
    df = with_fields(packets)
    scope = capture_scope(df)
    most = max(step for _, step, *_ in PROCEDURE_STEPS)
    hits = _step_hits(df.withColumn("ue", lte_ue(F.col("m"))).where(F.col("ue").isNotNull()), *scope, "ue")
    per_step = [F.count_if(F.col("step") == i).alias(f"n{i}") for i in range(1, most + 1)]
    per_step += [F.min(F.when(F.col("step") == i, F.col("packet_number"))).alias(f"p{i}") for i in range(1, most + 1)]
    seen = hits.groupBy(*scope, "ue", "procedure").agg(F.bit_or(F.expr("shiftleft(1, CAST(step AS INT) - 1)")).alias("steps_seen"), *per_step)
    bits = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"n{i}").alias("packets"), F.col(f"p{i}").alias("first_packet")) for i in range(1, most + 1)])
    sizes = F.create_map(*[x for name in sorted({p for p, *_ in PROCEDURE_STEPS}) for x in (F.lit(name), F.lit(sum(p == name for p, *_ in PROCEDURE_STEPS)))])
    total = F.element_at(sizes, F.col("procedure"))
    spread = seen.select(*scope, "ue", "procedure", "steps_seen", total.alias("total"), F.explode(F.slice(bits, F.lit(1), total)).alias("s"))
    return spread.select(
        *scope, "ue", "procedure", F.col("s.step").cast("int").alias("step"), "s.packets", F.col("s.first_packet").cast("double").alias("first_packet"),
        (F.col("s.packets") > 0).alias("seen"), F.col("steps_seen").cast("bigint").alias("steps_seen"), (F.bit_count("steps_seen") == F.col("total")).alias("complete"),
    )
