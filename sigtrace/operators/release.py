"""Release-cause and handover-failure analysis over NGAP packets.

Every operator is a DataFrame -> DataFrame function over the whole ``packets``
table.  Per-packet work (cause decoding, classification) is a projection; the
summaries are single-pass aggregations with map-side partial aggregation, so a UE
or category holding a third of all rows only grows a partial-aggregate buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrace.functions import codes
from sigtrace.functions.fields import (
    AMF_KEYS,
    NGAP_PROC_KEYS,
    RAN_KEYS,
    capture_scope,
    first_entry_where,
    first_of,
    has_key,
    packet_key,
    val,
    with_fields,
)
from sigtrace.functions.lookup import contains_any, first_keyword, lookup

DEFAULT_RELEASE_CODES = ("41",)


def _in_capture(df: DataFrame, ue_id: Column) -> Column:
    """What tells a UE id from that of another capture: the id itself, with its capture in a table of several."""
    scope = capture_scope(df)
    return F.when(ue_id.isNotNull(), F.struct(*[F.col(c) for c in scope], ue_id.alias("id"))) if scope else ue_id


# ---------------------------------------------------------------------------
# Cause decoding and classification (column expressions)
# ---------------------------------------------------------------------------
def decode_cause(group: Column, value: Column) -> Column:
    """(cause group, value) -> 3GPP cause name; unknown value -> ``<group>-<value>``.

    NULL when the group is not 0-4 or the value field is absent.
    """
    gname = lookup(codes.CAUSE_GROUPS, group)
    flat = {f"{g}:{k}": v for g, tbl in codes.CAUSE_VALUES.items() for k, v in tbl.items()}
    known = lookup(flat, F.concat(group, F.lit(":"), value))
    return F.when(gname.isNotNull() & value.isNotNull(), F.coalesce(known, F.concat(gname, F.lit("-"), value)))


def cause_value_field(m: Column, group: Column) -> Column:
    """Value of ``ngap.ngap.<groupName>`` for the packet's cause group."""
    gname = lookup(codes.CAUSE_GROUPS, group)
    return m[F.concat(F.lit("ngap.ngap."), gname)]


def classify_category(text: Column) -> Column:
    """First abnormal keyword, else first normal keyword, else 'other'."""
    return F.coalesce(
        first_keyword(text, codes.ABNORMAL_KEYWORDS), first_keyword(text, codes.NORMAL_KEYWORDS), F.lit("other")
    )


def classify_normal(text: Column) -> Column:
    return first_keyword(text, codes.ABNORMAL_KEYWORDS).isNull()


def classify_standard(text: Column) -> Column:
    """Normal flag from the published 3GPP cause table, else the keyword rule."""
    table = {c: "1" for c in codes.STANDARD_NORMAL_CAUSES}
    table.update({c: "0" for c in codes.STANDARD_ABNORMAL_CAUSES})
    std = lookup(table, text)
    return F.coalesce(std == F.lit("1"), classify_normal(text))


def _release_key(k: Column) -> Column:
    lk = F.lower(k)
    return lk.contains("release") & (lk.contains("uecontext") | lk.contains("ue_context"))


def is_release_packet(m: Column, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> Column:
    proc = first_of(m, NGAP_PROC_KEYS)
    return F.coalesce(proc.isin(list(release_codes)), F.lit(False)) | has_key(m, _release_key)


def release_type(m: Column) -> Column:
    """K18: 'Request' if any key mentions request, else 'Command' if any mentions command."""
    return (
        F.when(has_key(m, lambda k: F.lower(k).contains("request")), "Request")
        .when(has_key(m, lambda k: F.lower(k).contains("command")), "Command")
        .otherwise("Complete")
    )


# ---------------------------------------------------------------------------
# R2: release events
# ---------------------------------------------------------------------------
def _event_cause(m: Column) -> Column:
    """Decoded cause, else the first 'cause' key's value, else a hint-word value."""
    grp = val(m, "ngap.ngap.Cause")
    decoded = decode_cause(grp, cause_value_field(m, grp))
    # Fallback 1: value of the first key mentioning 'cause' ('' counts as absent).
    by_key = F.nullif(first_entry_where(m, lambda k, v: F.lower(k).contains("cause"))["value"], F.lit(""))
    # Fallback 2: first value carrying one of the hint words.
    by_hint = F.nullif(first_entry_where(m, lambda k, v: contains_any(v, codes.CAUSE_HINT_WORDS))["value"], F.lit(""))
    return F.coalesce(F.nullif(decoded, F.lit("")), by_key, by_hint, F.lit("unspecified"))


def release_events(packets: DataFrame, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> DataFrame:
    """One row per release packet with ids, decoded cause, category and normal flag."""
    df = with_fields(packets)
    m = F.col("m")
    cause = _event_cause(m)
    proc = first_of(m, NGAP_PROC_KEYS)
    out = (
        df.where(is_release_packet(m, release_codes))
        .select(
            *packet_key(df),
            first_of(m, RAN_KEYS).alias("ran_ue_id"),
            first_of(m, AMF_KEYS).alias("amf_ue_id"),
            proc.alias("procedure_code"),
            lookup(codes.NGAP_PROCEDURES, proc).alias("procedure_name"),
            cause.alias("cause_raw"),
            release_type(m).alias("release_type"),
        )
        .withColumn("cause_category", classify_category(F.col("cause_raw")))
        .withColumn("normal", classify_normal(F.col("cause_raw")))
    )
    return out


# ---------------------------------------------------------------------------
# UE counts and release statistics
# ---------------------------------------------------------------------------
def _initial_ue(m: Column, message_type: Column) -> Column:
    proc = first_of(m, NGAP_PROC_KEYS)
    return (
        F.coalesce(message_type == "15", F.lit(False))
        | F.coalesce(proc == "15", F.lit(False))
        | F.coalesce(F.lower(message_type).contains("initialuemessage"), F.lit(False))
        | has_key(m, lambda k: F.lower(k).contains("initialuemessage"))
    )


def _ue_count_columns(df: DataFrame) -> list[Column]:
    m = F.col("m")
    return [
        F.countDistinct(_in_capture(df, first_of(m, RAN_KEYS))).alias("ran_total"),
        F.countDistinct(_in_capture(df, first_of(m, AMF_KEYS))).alias("amf_total"),
        F.count_if(_initial_ue(m, F.col("message_type"))).alias("initial_ue_messages"),
    ]


def ngap_ue_counts(packets: DataFrame) -> DataFrame:
    """Distinct RAN ids, distinct AMF ids, InitialUEMessage packets (one row)."""
    df = with_fields(packets)
    return df.agg(*_ue_count_columns(df))


def release_stats(packets: DataFrame, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> DataFrame:
    """Totals, normal/abnormal counts and %, failure rate per unique RAN id, status.

    One scan and one global aggregate: release flags are per-row projections.
    """
    df = with_fields(packets)
    m = F.col("m")
    rel = is_release_packet(m, release_codes)
    flagged = df.select(
        *capture_scope(df),
        "message_type",
        "m",
        rel.alias("_rel"),
        # the cause is only worked out for release packets (CASE evaluates lazily per row)
        F.when(rel, classify_normal(_event_cause(m))).alias("_normal"),
    )
    agg = flagged.agg(
        F.count_if("_rel").alias("total_releases"),
        F.count_if(F.col("_rel") & F.col("_normal")).alias("normal_count"),
        F.count_if(F.col("_rel") & ~F.col("_normal")).alias("abnormal_count"),
        *_ue_count_columns(flagged),
    )
    total = F.col("total_releases")
    rate = F.when(F.col("ran_total") > 0, F.col("abnormal_count") * 100.0 / F.greatest(F.col("ran_total"), F.lit(1))).otherwise(0.0)
    return agg.select(
        "total_releases",
        "normal_count",
        "abnormal_count",
        F.round(F.when(total > 0, F.col("normal_count") * 100.0 / total).otherwise(0.0), 4).alias("normal_pct"),
        F.round(F.when(total > 0, F.col("abnormal_count") * 100.0 / total).otherwise(0.0), 4).alias("abnormal_pct"),
        "ran_total",
        "amf_total",
        "initial_ue_messages",
        F.round(rate, 4).alias("failure_rate_pct"),
        F.when(rate < 50, "OK").when(rate < 100, "ELEVATED").otherwise("HIGH").alias("status"),
    )


# ---------------------------------------------------------------------------
# breakdowns
# ---------------------------------------------------------------------------
def release_by_category(packets: DataFrame, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> DataFrame:
    """Per category normal / abnormal / total / % of releases, with distinct UE count.

    The reference prints the UE id list of each category; that list grows with the
    data, so it is a separate long-form operator (:func:`release_category_ues`).
    """
    ev = release_events(packets, release_codes)
    by_cat = ev.groupBy("cause_category").agg(
        F.count_if(F.col("normal")).alias("normal"),
        F.count_if(~F.col("normal")).alias("abnormal"),
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(_in_capture(ev, F.col("ran_ue_id"))).alias("ues"),
    )
    # The window runs over the aggregated rows only: one per category (at most 12).
    return by_cat.withColumn(
        "pct_of_releases", F.round(F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy()), 4)
    )


def release_category_ues(packets: DataFrame, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> DataFrame:
    """R7 UE lists in long form: (category, RAN id, releases of that UE in the category)."""
    ev = release_events(packets, release_codes).where(F.col("ran_ue_id").isNotNull())
    return ev.groupBy("cause_category", *capture_scope(ev), "ran_ue_id").agg(F.count(F.lit(1)).alias("releases"))


def release_by_cause(packets: DataFrame, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> DataFrame:
    """Per (category, cause): count, % of releases, NORMAL/ABNORMAL, standard class."""
    ev = release_events(packets, release_codes)
    g = ev.groupBy("cause_category", "cause_raw", "normal").agg(F.count(F.lit(1)).alias("count"))
    total = ev.agg(F.count(F.lit(1)).alias("n")).scalar()  # one number for the whole table
    return g.select(
        "cause_category",
        "cause_raw",
        "count",
        F.round(F.col("count") * 100.0 / total, 4).alias("pct_of_releases"),
        F.when(F.col("normal"), "NORMAL").otherwise("ABNORMAL").alias("classification"),
        F.when(classify_standard(F.col("cause_raw")), "NORMAL").otherwise("ABNORMAL").alias("standard_classification"),
    )


# ---------------------------------------------------------------------------
# Per-UE detail
# ---------------------------------------------------------------------------
def _detail_cause(m: Column) -> Column:
    grp = val(m, "ngap.ngap.Cause")
    return F.coalesce(F.nullif(decode_cause(grp, cause_value_field(m, grp)), F.lit("")), F.lit("unspecified"))


def ue_release_detail(packets: DataFrame, ran_ue_id: str | None = None) -> DataFrame:
    """Release packets of one UE (or all UEs): type, cause, category, status."""
    df = with_fields(packets)
    m = F.col("m")
    ran = val(m, "ngap.ngap.RAN_UE_NGAP_ID")
    df = df.where(ran.isNotNull() & has_key(m, _release_key))
    if ran_ue_id is not None:
        df = df.where(ran == F.lit(str(ran_ue_id)))
    cause = _detail_cause(m)
    return df.select(
        ran.alias("ran_ue_id"),
        *packet_key(df),
        release_type(m).alias("release_type"),
        cause.alias("cause"),
        classify_category(cause).alias("category"),
        F.when(classify_normal(cause), "NORMAL").otherwise("ABNORMAL").alias("status"),
    )


def ue_procedure_timeline(packets: DataFrame, ran_ue_id: str | None = None) -> DataFrame:
    """NGAP packets of a UE with their procedure name (``Procedure-<code>`` when unknown)."""
    df = with_fields(packets)
    m = F.col("m")
    ran = val(m, "ngap.ngap.RAN_UE_NGAP_ID")
    proc = val(m, "ngap.ngap.procedureCode")
    df = df.where(ran.isNotNull())
    if ran_ue_id is not None:
        df = df.where(ran == F.lit(str(ran_ue_id)))
    small = {"4": "DownlinkNASTransport", "14": "InitialContextSetup", "15": "InitialUEMessage",
             "21": "UEContextRelease", "29": "PDUSessionResourceSetup"}
    return df.select(
        ran.alias("ran_ue_id"),
        *packet_key(df),
        proc.alias("procedure_code"),
        F.coalesce(lookup(small, proc), F.concat(F.lit("Procedure-"), F.coalesce(proc, F.lit("None")))).alias("procedure"),
        F.coalesce(F.length(F.nullif(proc, F.lit(""))) > 0, F.lit(False)).alias("is_procedure"),
        has_key(m, _release_key).alias("is_release"),
    )


def ue_procedure_totals(packets: DataFrame) -> DataFrame:
    """R10 totals per UE: packets, procedures, release events."""
    t = ue_procedure_timeline(packets)
    return t.groupBy(*capture_scope(t), "ran_ue_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("is_procedure").alias("procedures"),
        F.count_if("is_release").alias("releases"),
    )


# ---------------------------------------------------------------------------
# Handover outcome of radioNetwork releases
# ---------------------------------------------------------------------------
def handover_events(packets: DataFrame) -> DataFrame:
    """Release packets with a radioNetwork cause, tagged failure / success / NULL."""
    df = with_fields(packets)
    m = F.col("m")
    ran = F.nullif(val(m, "ngap.ngap.RAN_UE_NGAP_ID"), F.lit(""))
    cv = val(m, "ngap.ngap.radioNetwork")
    outcome = lookup({c: "failure" for c in codes.HO_FAILURE_CAUSES} | {c: "success" for c in codes.HO_SUCCESS_CAUSES}, cv)
    return df.where(
        ran.isNotNull() & has_key(m, _release_key) & (val(m, "ngap.ngap.Cause") == "0") & cv.isNotNull()
    ).select(
        ran.alias("ran_ue_id"),
        *packet_key(df),
        cv.alias("cause_code"),
        F.coalesce(lookup(codes.CAUSE_RADIO_NETWORK, cv), F.concat(F.lit("radioNetwork-"), cv)).alias("cause"),
        outcome.alias("outcome"),
    )


def handover_failures_by_ue(packets: DataFrame) -> DataFrame:
    """R12 per UE: failure and success counts (UEs with any radioNetwork release)."""
    events = handover_events(packets)
    return events.groupBy(*capture_scope(events), "ran_ue_id").agg(
        F.count_if(F.col("outcome") == "failure").alias("failure_count"),
        F.count_if(F.col("outcome") == "success").alias("success_count"),
    )


def handover_failures(packets: DataFrame) -> DataFrame:
    """R12 overall: UEs with events / with failures / with successes only."""
    per = handover_failures_by_ue(packets)
    return per.agg(
        F.count(F.lit(1)).alias("ues_with_events"),
        F.count_if(F.col("failure_count") > 0).alias("ues_with_failures"),
        F.count_if((F.col("failure_count") == 0) & (F.col("success_count") > 0)).alias("ues_success_only"),
        F.coalesce(F.sum("failure_count"), F.lit(0)).cast("bigint").alias("failures"),
        F.coalesce(F.sum("success_count"), F.lit(0)).cast("bigint").alias("successes"),
    )


# ---------------------------------------------------------------------------
# Interpretation notes
# ---------------------------------------------------------------------------
def cause_note(cause: Column) -> Column:
    expr = F.lit(None).cast("string")
    for pattern, note in reversed(codes.CAUSE_NOTES):
        text = F.replace(F.lit(note), F.lit("{cause}"), cause) if "{cause}" in note else F.lit(note)
        expr = F.when(cause.contains(pattern), text).otherwise(expr)
    return expr


def _first_contained(cause: Column, rules: Sequence[tuple[str, str]]) -> Column:
    expr = F.lit(None).cast("string")
    for pattern, text in reversed(rules):
        expr = F.when(cause.contains(pattern), F.lit(text)).otherwise(expr)
    return expr


def handover_note(cause: Column) -> Column:
    return _first_contained(cause, codes.HO_FAILURE_NOTES)


def handover_reasons(cause: Column) -> Column:
    return _first_contained(cause, codes.HO_FAILURE_REASONS)


def cause_notes(packets: DataFrame) -> DataFrame:
    """Distinct release causes with their interpretation note (NULL when none applies);
    handover failures also with the possible reasons."""
    d = ue_release_detail(packets).select("cause").distinct()
    h = handover_events(packets).where(F.col("outcome") == "failure").select("cause").distinct()
    return d.select("cause", cause_note(F.col("cause")).alias("note"), F.lit("release").alias("kind"), F.lit(None).cast("string").alias("possible_reasons")).unionByName(
        h.select("cause", handover_note(F.col("cause")).alias("note"), F.lit("handover_failure").alias("kind"), handover_reasons(F.col("cause")).alias("possible_reasons"))
    )


# ---------------------------------------------------------------------------
# R1 / R3 / R4 as table operators
# ---------------------------------------------------------------------------
def decoded_causes(packets: DataFrame) -> DataFrame:
    """R1 over packets: every packet carrying a cause group, with its decoded name."""
    df = with_fields(packets)
    m = F.col("m")
    grp = val(m, "ngap.ngap.Cause")
    cv = cause_value_field(m, grp)
    return df.where(grp.isNotNull()).select(
        *packet_key(df), grp.alias("cause_group"), cv.alias("cause_value"), decode_cause(grp, cv).alias("cause_name")
    )


def cause_classes(packets: DataFrame, release_codes: Sequence[str] = DEFAULT_RELEASE_CODES) -> DataFrame:
    """R3 + R4: each distinct release cause text with keyword and standard classification."""
    ev = release_events(packets, release_codes).select("cause_raw").distinct()
    c = F.col("cause_raw")
    return ev.select(
        "cause_raw",
        classify_category(c).alias("cause_category"),
        classify_normal(c).alias("normal"),
        classify_standard(c).alias("standard_normal"),
    )


# ---------------------------------------------------------------------------
# Does a UE have a given message?
# ---------------------------------------------------------------------------
def _squash(c: Column) -> Column:
    """Lower-case without blanks, ``-`` and ``_`` (message-name comparison form)."""
    return F.regexp_replace(F.lower(c), r"[ \-_]", "")


def _prefix_match(a: Column, b: Column) -> Column:
    """Either string longer than 5 and the first 80 % of the shorter length equal."""
    t = F.floor(F.least(F.length(a), F.length(b)) * F.lit(0.8)).cast("int")
    return ((F.length(a) > 5) | (F.length(b) > 5)) & (F.substring(a, 1, t) == F.substring(b, 1, t))


def _either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def ue_has_message(packets: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request ``(ue_id, message)``, the UE's packets that carry the message.

    Match on the message type (normalised substring either way, or the 80 % prefix
    rule), else on the first ``*_element`` / ``*Transfer*`` field name that matches the
    same way (its name is shown as the sub-message).  ``requests`` is joined on the
    RAN UE id, so any number of (UE, message) questions run as one job.
    """
    df = with_fields(packets)
    m = F.col("m")
    ran = F.nullif(val(m, "ngap.ngap.RAN_UE_NGAP_ID"), F.lit(""))
    pk = df.select(*packet_key(df), "timestamp_iso", "message_type", "m", ran.alias("ue_id")).where(F.col("ue_id").isNotNull())
    named = capture_scope(requests) if capture_scope(df) else []  # requests may name their capture
    req = requests.select(*named, F.col("ue_id").cast("string").alias("ue_id"), F.col("message").alias("message"))
    j = pk.join(req, [*named, "ue_id"])
    q = _squash(F.col("message"))
    mt = F.col("message_type")
    pn = _squash(mt)
    by_type = F.coalesce(F.length(F.nullif(mt, F.lit(""))) > 0, F.lit(False)) & (_either_contains(q, pn) | _prefix_match(q, pn))

    def field_norm(k: Column) -> Column:
        x = F.replace(F.replace(F.lower(k), F.lit("."), F.lit("")), F.lit("ngap"), F.lit(""))
        x = F.replace(x, F.lit("_element"), F.lit(""))
        return F.replace(F.replace(x, F.lit("_"), F.lit("")), F.lit("-"), F.lit(""))

    sub_key = F.get(
        F.filter(
            F.map_keys(m),
            lambda k: (k.contains("_element") | k.contains("Transfer"))
            & (_either_contains(q, field_norm(k)) | _prefix_match(q, field_norm(k))),
        ),
        0,
    )
    sub = F.replace(F.element_at(F.split(sub_key, r"\."), -1), F.lit("_element"), F.lit(""))
    matched = j.withColumn("_by_type", by_type).withColumn("_sub", F.when(~F.col("_by_type"), sub))
    return matched.where(F.col("_by_type") | F.col("_sub").isNotNull()).select(
        "ue_id",
        "message",
        *packet_key(df),
        F.when(F.col("_sub").isNotNull(), F.concat(mt, F.lit(" ("), F.col("_sub"), F.lit(")"))).otherwise(mt).alias("matched_message"),
        F.substring("timestamp_iso", 1, 23).alias("time"),
    )


# Messages asked about for every UE in the registered query (fixed question list).
UE_MESSAGE_QUESTIONS = ["HandoverNotification", "InitialContextSetup", "HandoverRequired", "PDU Session Resource Setup"]


def ue_message_requests(packets: DataFrame) -> DataFrame:
    """(ue_id, message) for every RAN UE id present and each question (no join: explode)."""
    df = with_fields(packets)
    ran = F.nullif(val(F.col("m"), "ngap.ngap.RAN_UE_NGAP_ID"), F.lit(""))
    ids = df.select(*capture_scope(df), ran.alias("ue_id")).where(F.col("ue_id").isNotNull()).distinct()
    return ids.select(*ids.columns, F.explode(F.array(*[F.lit(x) for x in UE_MESSAGE_QUESTIONS])).alias("message"))
