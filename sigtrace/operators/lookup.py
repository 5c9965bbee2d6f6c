"""Field-value lookup (V1-V6).

All lookups run over ``explode(map_entries(m))`` of the whole table.  "Use the
exact field if the data has it, else fall back to fuzzy matches" is decided with a
scalar subquery (one aggregated value), never with a driver-side count, so the
whole decision stays inside one Spark plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrace.functions.fields import capture_scope, first_of, packet_key, with_fields
from sigtrace.operators.catalog import field_score

# FIXED VALUES: fields that name a UE on a lookup row, in priority order.
UE_ID_KEYS = ["s1ap.s1ap.ENB_UE_S1AP_ID", "rlc_lte.rlc-lte.ueid", "s1ap.s1ap.MME_UE_S1AP_ID", "ngap.RAN_UE_NGAP_ID"]


def _norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-_.]", "")


def _norm_term(s: str) -> str:
    return s.lower().replace("-", "").replace("_", "").replace(" ", "")


def _entries(packets: DataFrame) -> DataFrame:
    df = with_fields(packets)
    key = packet_key(df)
    return df.select(
        *key,
        "message_type",
        F.coalesce(first_of(F.col("m"), UE_ID_KEYS), F.lit("")).alias("ue_id"),
        F.posexplode(F.map_entries("m")).alias("pos", "e"),
    ).select(*key, "message_type", "ue_id", "pos", F.col("e.key").alias("field"), F.col("e.value").alias("value"))


def field_dictionary(packets: DataFrame) -> DataFrame:
    """(field, n, first_packet): how often each field has a value, and the first packet with one.

    Its size is the vocabulary's, not the data's.  ``write_field_dictionary`` stores it, so that lookups by name need
    no scan of the packets to find out which fields there are.
    """
    df = with_fields(packets)
    ent = df.select("packet_number", F.explode(F.map_entries("m")).alias("e")).where(F.col("e.value").isNotNull() & (F.col("e.value") != ""))
    return ent.groupBy(F.col("e.key").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.min("packet_number").alias("first_packet"))


def write_field_dictionary(packets: DataFrame, path: str) -> DataFrame:
    field_dictionary(packets).coalesce(1).write.mode("overwrite").parquet(path)
    return packets.sparkSession.read.parquet(path)


def _fields_for(dictionary: DataFrame, name: str) -> Column:
    """V1's fields as one array: the best exact field name, or (where there is none) all whose normal form contains the name's."""
    nq = name.lower().replace("-", "").replace("_", "").replace(".", "")
    norm = _norm_key(F.col("field"))
    exact = norm.contains(F.lit(nq)) | F.lit(nq).contains(norm)
    best = F.min_by(F.col("field"), F.when(exact, F.struct(-field_score(F.col("field"), name), F.col("field"))))
    fuzzy = F.collect_set(F.when(norm.contains(F.lit(_norm_term(name))), F.col("field")))  # field names only: a vocabulary
    found = dictionary.agg(best.alias("best"), fuzzy.alias("fuzzy"))
    return found.select(F.when(F.col("best").isNotNull(), F.array("best")).otherwise(F.col("fuzzy")).alias("fields")).scalar()


def field_values(packets: DataFrame, name: str, dictionary: DataFrame | None = None) -> DataFrame:
    """V1: (packet_number, ue_id, field, value) for a field name.

    Tier 1: the best exact field name for ``name`` (highest catalog score, then name);
    tier 2 (only when tier 1 finds nothing anywhere): every field whose normal form
    contains the name's.  Empty values dropped, duplicates removed, ``*flag*`` fields
    hidden unless the name mentions a flag.

    The fields are resolved on ``dictionary`` (:func:`field_dictionary` of the table, or a stored one), and one scan of
    the packets takes these fields' values only.
    """
    fields = _fields_for(field_dictionary(packets) if dictionary is None else dictionary, name)
    df = with_fields(packets)
    key = packet_key(df)
    wanted = lambda e: F.array_contains("_fields", e["key"]) & e["value"].isNotNull() & (e["value"] != "")
    if "flag" not in name.lower():
        plain = wanted
        wanted = lambda e: plain(e) & ~F.lower(e["key"]).contains("flag")
    rows = df.select(*key, "m", F.coalesce(first_of(F.col("m"), UE_ID_KEYS), F.lit("")).alias("ue_id"), fields.alias("_fields"))
    hits = rows.select(*key, "ue_id", F.explode(F.filter(F.map_entries("m"), wanted)).alias("e"))
    # a map holds each key once, so a packet gives each (field, value) once; packets read twice are not
    return hits.select(*key, "ue_id", F.col("e.key").alias("field"), F.col("e.value").alias("value")).dropDuplicates([*key, "field", "value"])


def field_value_distinct(packets: DataFrame, name: str) -> DataFrame:
    """V2: "what is X" form - the earliest row of each distinct value."""
    rows = field_values(packets, name)
    scope = capture_scope(rows)
    return rows.groupBy(*scope, "value").agg(
        F.min_by(F.struct("packet_number", "ue_id", "field"), F.col("packet_number")).alias("r")
    ).select(*scope, "value", "r.packet_number", "r.ue_id", "r.field")


def field_value_best(packets: DataFrame, name: str) -> DataFrame:
    """V3: the single best-scoring (field, value) for a name over the whole table (of several captures: in each).

    Score = length of the normalised name, +10 when the normalised field ends with
    it, +5 for field names under 50 characters, +15 when the field name ends with
    the name in one of its spellings; ties go to the earliest packet, then field order.
    """
    term = _norm_term(name)
    spellings = sorted({name.lower(), name.lower().replace("-", "_"), name.lower().replace("_", "-"), term})
    ent = _entries(packets)
    fk = _norm_key(F.col("field"))
    ends = F.lit(False)
    for s in spellings:
        ends = ends | F.lower(F.col("field")).endswith(s)
    score = (
        F.lit(len(term))
        + F.when(fk.endswith(term), 10).otherwise(0)
        + F.when(F.length("field") < 50, 5).otherwise(0)
        + F.when(ends, 15).otherwise(0)
    )
    scope = capture_scope(ent)
    m = ent.where(fk.contains(term)).select(*scope, "packet_number", "pos", "field", "value", score.alias("score"))
    return m.groupBy(*scope).agg(
        F.min_by(F.struct("field", "value", "score", "packet_number"), F.struct(-F.col("score"), F.col("packet_number"), F.col("pos"))).alias("b")
    ).where(F.col("b").isNotNull()).select(*scope, "b.field", "b.value", "b.score", "b.packet_number")


def value_search(packets: DataFrame, token: str, top: int = 10) -> DataFrame:
    """V4: distinct (field, value) whose field name contains the token or is contained in it,
    ranked exact name -> starts with the token -> shorter name; top ``top``."""
    t = _norm_term(token)
    ent = _entries(packets).where(F.col("value").isNotNull() & (F.col("value") != ""))
    kn = F.regexp_replace(F.lower(F.col("field")), r"[-_. ]", "")
    hits = ent.where(kn.contains(F.lit(t)) | F.lit(t).contains(kn)).select("field", "value").distinct()
    fnorm = _norm_key(F.col("field"))
    ranked = hits.select(
        "field",
        "value",
        F.when(fnorm == t, 0).otherwise(1).alias("r_exact"),
        F.when(F.locate(t, fnorm) == 1, 0).otherwise(1).alias("r_start"),
        F.length(fnorm).alias("r_len"),
    )
    return ranked.orderBy("r_exact", "r_start", "r_len", "field", "value").limit(top)


# FIXED VALUES: a TAC field name is "tac" bounded by start/end or one of _ . -
TAC_PATTERN = r"(^|[_.-])tac($|[_.-])"


# FIXED VALUES: fields that anchor a 5G UE, one of them a packet.
RAN_ANCHORS = ["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID", "RAN_UE_NGAP_ID"]


def value_search_for_ues(packets: DataFrame, token: str, top: int = 10, ues: DataFrame | None = None) -> DataFrame:
    """V4 per UE: the ``top`` (field, value) pairs of each UE's own packets; where a UE has none, those of all
    packets (the field may be broadcast), marked ``anchored = false``.

    ``ues`` (column ``ue_id``, and ``capture`` where it matters) says whose; without it every RAN id of the table.
    """
    df = with_fields(packets)
    scope = capture_scope(df)
    t = _norm_term(token)
    kn = lambda k: F.regexp_replace(F.lower(k), r"[-_. ]", "")
    found = F.filter(F.map_entries("m"), lambda e: e["value"].isNotNull() & (e["value"] != "") & (kn(e["key"]).contains(F.lit(t)) | F.lit(t).contains(kn(e["key"]))))
    ue = first_of(F.col("m"), RAN_ANCHORS)
    hits = df.select(*scope, ue.alias("ue_id"), F.explode(found).alias("e")).select(*scope, "ue_id", F.col("e.key").alias("field"), F.col("e.value").alias("value"))
    fnorm = _norm_key(F.col("field"))
    rank = F.struct(F.when(fnorm == t, 0).otherwise(1).alias("r_exact"), F.when(F.locate(t, fnorm) == 1, 0).otherwise(1).alias("r_start"), F.length(fnorm).alias("r_len"), "field", "value")
    order = lambda *by: Window.partitionBy(*by).orderBy("r")
    own = hits.where(F.col("ue_id").isNotNull()).distinct().select(*scope, "ue_id", rank.alias("r"))
    own = own.withColumn("rank", F.row_number().over(order(*scope, "ue_id"))).where(F.col("rank") <= top)
    # of all packets, at most `top` rows (of each capture), so one array
    common = hits.select(*scope, "field", "value").distinct().select(*scope, rank.alias("r"))
    common = common.withColumn("rank", F.row_number().over(order(*scope))).where(F.col("rank") <= top)
    common = common.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("rank", "r"))).alias("all"))
    ids = df.select(*scope, ue.alias("ue_id")).where(F.col("ue_id").isNotNull()).distinct()
    if ues is not None:
        named = [c for c in scope if c in ues.columns]
        ids = ids.join(ues.select(*named, F.col("ue_id").cast("string").alias("ue_id")).distinct(), [*named, "ue_id"], "left_semi")
        own = own.join(ids, [*scope, "ue_id"], "left_semi")
    rest = ids.join(own.select(*scope, "ue_id").distinct(), [*scope, "ue_id"], "left_anti")
    if scope:
        rest = rest.join(common, scope)
    else:
        rest = rest.withColumn("all", common.select("all").scalar())
    rest = rest.select(*scope, "ue_id", F.explode("all").alias("x")).select(*scope, "ue_id", "x.r", "x.rank")
    both = own.withColumn("anchored", F.lit(True)).unionByName(rest.withColumn("anchored", F.lit(False)))
    return both.select(*scope, "ue_id", "anchored", F.col("rank").cast("bigint").alias("rank"), "r.field", "r.value")


def _identity_rows(packets: DataFrame) -> DataFrame:
    """Packets that mention a PLMN or TAC, with the values they give and whether they are a Registration Complete."""
    # the lower-cased text behind an explode, so it is worked out once per packet (see with_fields)
    df = with_fields(packets).select("*", F.explode(F.array(F.lower("protocol_fields_json"))).alias("_low"))
    low = F.col("_low")
    cand = df.where(low.contains("plmnidentity") | low.contains("plmn-id.mcc") | low.contains("plmn-id.mnc") | low.contains("tac"))
    ent = F.map_entries("m")
    plmn = F.get(F.filter(ent, lambda e: F.lower(e["key"]).contains("plmnidentity") & (e["value"] != "")), 0)["value"]
    mcc = F.get(F.filter(ent, lambda e: F.lower(e["key"]).endswith(".mcc")), 0)["value"]
    mnc = F.get(F.filter(ent, lambda e: F.lower(e["key"]).endswith(".mnc")), 0)["value"]
    plmn_v = F.coalesce(
        plmn,
        F.when((F.coalesce(mcc, F.lit("")) != "") & (F.coalesce(mnc, F.lit("")) != ""), F.concat(F.lit("MCC="), mcc, F.lit(", MNC="), mnc)),
    )
    tac_v = F.get(F.filter(ent, lambda e: F.lower(e["key"]).rlike(TAC_PATTERN) & (e["value"] != "")), 0)["value"]
    complete = F.coalesce(F.lower(F.col("message_type")) == "registrationcomplete", F.lit(False)) | low.contains("registrationcomplete")
    return cand.select(*packet_key(df), first_of(F.col("m"), RAN_ANCHORS).alias("ue_id"), plmn_v.alias("plmn"), tac_v.alias("tac"), complete.alias("complete"))


def _identity_of(rows: DataFrame, by: list[str], registration_complete: bool) -> DataFrame:
    """PLMN and TAC of each group, first in packet order; with ``registration_complete`` from the Registration Complete
    messages of the group, or from all its rows if it has none - both worked out in the one aggregate."""
    wide = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("packet_number"))).alias(c) for c in ("plmn", "tac")]
    narrow = [F.min_by(c, F.when(F.col(c).isNotNull() & F.col("complete"), F.col("packet_number"))).alias(f"{c}_narrow") for c in ("plmn", "tac")]
    agg = rows.groupBy(*by).agg(F.count_if("complete").alias("n"), *wide, *narrow)
    chosen = lambda c: F.when((F.col("n") > 0) & F.lit(registration_complete), F.col(f"{c}_narrow")).otherwise(F.col(c))
    return agg.select(*by, chosen("plmn").alias("plmn_identity"), chosen("tac").alias("tac"))


def plmn_tac(packets: DataFrame, registration_complete: bool = False) -> DataFrame:
    """V5: PLMN identity (or ``MCC=.., MNC=..``) and TAC, first in packet order.

    The two are looked up separately, so a packet that carries only one counts for it.
    With ``registration_complete`` only Registration Complete messages count, a filter
    dropped again when it leaves nothing (decided in the aggregate).  One row for the table, for one of several
    captures one of each that mentions either.
    """
    rows = _identity_rows(packets)
    return _identity_of(rows, capture_scope(rows), registration_complete)


def plmn_tac_by_ue(packets: DataFrame, registration_complete: bool = True) -> DataFrame:
    """V5 per UE (RAN id): PLMN identity and TAC from the UE's own packets, each UE with its own choice of the filter."""
    rows = _identity_rows(packets).where(F.col("ue_id").isNotNull())
    return _identity_of(rows, [*capture_scope(rows), "ue_id"], registration_complete)


def pdn_ip(packets: DataFrame) -> DataFrame:
    """V6: PDN IPv4 address per ENB UE id (of each capture), from its first InitialContextSetup carrying one."""
    df = with_fields(packets)
    scope = capture_scope(df)
    m = F.col("m")
    ip = m["s1ap.nas-eps.esm.pdn_ipv4"]
    enb = m["s1ap.s1ap.ENB_UE_S1AP_ID"]
    rows = df.where(F.col("message_type").like("%InitialContextSetup%") & enb.isNotNull() & ip.isNotNull()).select(
        *scope, enb.alias("ue_id"), ip.alias("pdn_ip_address"), "packet_number", "message_type"
    )
    return rows.groupBy(*scope, "ue_id").agg(
        F.min_by(F.struct("pdn_ip_address", "packet_number", "message_type"), F.col("packet_number")).alias("r")
    ).select(*scope, "ue_id", "r.pdn_ip_address", "r.packet_number", "r.message_type")
