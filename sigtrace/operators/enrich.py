"""Packet enrichment from dissected protocol layers.

Every function returns a Column over ``protocol_layers`` / ``protocol_stack`` (and
ports), written with higher-order functions (``filter``, ``transform``,
``aggregate``), so enrichment is one projection: map-only, no shuffle, and the
"first layer in stack order that yields a value" rules keep array order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.functions import codes
from sigtrace.functions.lookup import lookup

LAYERS = "protocol_layers"
STACK = "protocol_stack"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ---------------------------------------------------------------------------
# B1 / B2: code decoding
# ---------------------------------------------------------------------------
def decode_procedure(protocol: str, code: Column) -> Column:
    """B1: S1AP / NGAP procedure code -> name; unknown codes pass through."""
    table = codes.S1AP_PROCEDURES if protocol.upper() == "S1AP" else codes.NGAP_PROCEDURES
    return F.coalesce(lookup(table, code), code)


def nas_code(c: Column) -> Column:
    """NAS-5GS message code, hex (``0x41``) or decimal -> decimal text."""
    return F.when(F.lower(c).startswith("0x"), F.conv(F.right(c, F.length(c) - 2), 16, 10)).otherwise(c)


def decode_nas_5gs(mm_code: Column, sm_code: Column | None = None) -> Column:
    """B2: NAS-5GS mobility-management code first, else session-management code -> name."""
    mm = nas_code(mm_code)
    out = F.when(mm.isNotNull(), F.coalesce(lookup(codes.NAS_5GS_MM, mm), mm))
    if sm_code is not None:
        sm = nas_code(sm_code)
        out = out.when(sm.isNotNull(), F.coalesce(lookup(codes.NAS_5GS_SM, sm), sm))
    return out


# ---------------------------------------------------------------------------
# UE id
# ---------------------------------------------------------------------------
def extract_ue_id(layers: Column | str = LAYERS) -> Column:
    """First identifier by priority (RAN, ENB/MME, IMSI, GUTI, TMSI, RNTI), each
    looked up only in its own layers."""
    return _ue_id_from(layer_facts(layers))


# ---------------------------------------------------------------------------
# Message type
# ---------------------------------------------------------------------------
# FIXED VALUES: message-type fields per protocol family (tested in this order on each layer).
MESSAGE_FIELDS = [
    ("rrc", ["rrc.messageType", "lte-rrc.messageType", "nr-rrc.messageType"]),
    ("nas-eps", ["nas-eps.nas_msg_emm_type", "nas-eps.nas_msg_esm_type"]),
    ("nas-5gs", ["nas_5gs.mm.message_type", "nas_5gs.sm.message_type"]),
    ("s1ap", ["s1ap.procedureCode"]),
    ("x2ap", ["x2ap.procedureCode"]),
    ("ngap", ["ngap.procedureCode"]),
    ("gtpv2", ["gtpv2.message_type"]),
]
# FIXED VALUES: RRC container elements that do not name a message.
RRC_CONTAINERS = [
    "DL_CCCH_Message", "UL_CCCH_Message", "DL_DCCH_Message", "UL_DCCH_Message",
    "BCCH_BCH_Message", "BCCH_DL_SCH_Message", "PCCH_Message", "criticalExtensions",
]


def _layer_message_type(l: Column) -> Column:
    lname = F.lower(l["protocol_name"])
    candidates = []
    for family, fields in MESSAGE_FIELDS:
        v = _first_keys(l["fields"], fields)
        if family == "s1ap":
            v = decode_procedure("S1AP", v)
        elif family == "ngap":
            v = decode_procedure("NGAP", v)
        candidates.append(F.when(lname.contains(family), v))
    rrc_elem = F.get(
        F.filter(
            F.transform(
                F.filter(
                    F.map_keys(l["fields"]),
                    lambda k: (k.startswith("lte-rrc.") | k.startswith("nr-rrc.")) & k.endswith("_element") & (F.size(F.split(k, r"\.")) == 2),
                ),
                lambda k: F.replace(F.split(k, r"\.")[1], F.lit("_element"), F.lit("")),
            ),
            lambda n: ~n.isin(RRC_CONTAINERS),
        ),
        0,
    )
    candidates.append(F.when(l["protocol_name"] == "rlc-lte", rrc_elem))
    return F.coalesce(*candidates)


def extract_message_type(layers: Column | str = LAYERS) -> Column:
    """First layer (stack order) yielding a message type; S1AP/NGAP codes decoded."""
    return layer_facts(layers)["mt"]


# ---------------------------------------------------------------------------
# Protocol, interface, direction
# ---------------------------------------------------------------------------
# FIXED VALUES: protocol classification priority (first present wins).
PROTOCOL_PRIORITY = ["rrc", "nas-5gs", "nas-eps", "s1ap", "x2ap", "ngap", "gtpv2", "diameter"]


def extract_protocol(layers: Column | str = LAYERS) -> Column:
    """Highest-priority 3GPP protocol present (``rlc-lte`` carrying RRC fields counts as RRC)."""
    return _protocol_from(layer_facts(layers))


def lower_stack(stack: Column | str = STACK) -> Column:
    return F.transform(_c(stack), lambda p: F.lower(p))


def extract_interface(stack: Column | str = STACK, src_port: Column | None = None, dst_port: Column | None = None, low: Column | None = None) -> Column:
    """Uu / S1-MME / S1-U / S11 / X2 / N2 / N1 / SBI from the stack and ports.

    ``low`` is the :func:`lower_stack` where a caller has it as a column: each test below would work it out again.
    """
    low = lower_stack(stack) if low is None else low
    has = lambda p: F.coalesce(F.array_contains(low, p), F.lit(False))
    sp = src_port if src_port is not None else F.col("source_port")
    dp = dst_port if dst_port is not None else F.col("destination_port")
    port = lambda n: F.coalesce(sp == n, F.lit(False)) | F.coalesce(dp == n, F.lit(False))
    gtp = has("gtpv2") | has("gtp")
    return (
        F.when(has("rrc") | has("rlc"), "Uu")
        .when(has("s1ap"), "S1-MME")
        .when(gtp & port(2152), "S1-U")
        .when(gtp & port(2123), "S11")
        .when(has("x2ap"), "X2")
        .when(has("ngap"), "N2")
        .when(has("nas-5gs"), "N1")
        .when(has("http2"), "SBI")
    )


# FIXED VALUES: NAS message names that imply uplink / downlink.
UPLINK_NAS = ["attach request", "registration request", "service request", "authentication response"]
DOWNLINK_NAS = ["attach accept", "attach reject", "registration accept", "authentication request"]


def extract_direction(layers: Column | str = LAYERS) -> Column:
    """RRC direction text, else NAS message name lists (NAS codes decoded first, K13)."""
    return _direction_from(layer_facts(layers))


# ---------------------------------------------------------------------------
# Flattening and layer access
# ---------------------------------------------------------------------------
def flatten_fields(layers: Column | str = LAYERS) -> Column:
    """One map keyed ``<layer with - as _>.<field>``; a later layer wins on equal keys.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by :func:`sigtrace.session.configure`).
    """
    layers = _c(layers)
    return F.aggregate(
        layers,
        F.create_map().cast("map<string,string>"),
        lambda acc, l: F.map_concat(
            acc,
            F.transform_keys(
                F.coalesce(l["fields"], F.create_map().cast("map<string,string>")),
                lambda k, v: F.concat(F.replace(l["protocol_name"], F.lit("-"), F.lit("_")), F.lit("."), k),
            ),
        ),
    )


def protocol_layer(name: str, layers: Column | str = LAYERS) -> Column:
    """First layer whose name equals ``name`` case-insensitively (NULL when absent)."""
    layers = _c(layers)
    return F.get(F.filter(layers, lambda l: F.lower(l["protocol_name"]) == name.lower()), 0)


def layer_field(name: str, field: str, default: str | None = None, layers: Column | str = LAYERS) -> Column:
    v = protocol_layer(name, layers)["fields"][field]
    return v if default is None else F.coalesce(v, F.lit(default))


def has_protocol(name: str, stack: Column | str = STACK) -> Column:
    """Membership of a protocol in the stack, case-insensitive."""
    stack = _c(stack)
    return F.coalesce(F.exists(stack, lambda p: F.lower(p) == name.lower()), F.lit(False))


# ---------------------------------------------------------------------------
# Everything in one pass over the layers
# ---------------------------------------------------------------------------
PROTOCOL_NAMES = [p.upper().replace("-", "_") for p in PROTOCOL_PRIORITY]


def _layer_rank(l: Column) -> Column:
    """Priority rank of the most important protocol a layer names (NULL when none)."""
    lname = F.lower(l["protocol_name"])
    rrc_fields = (l["protocol_name"] == "rlc-lte") & F.exists(
        F.map_keys(l["fields"]), lambda k: k.startswith("lte-rrc.") | k.startswith("nr-rrc.")
    )
    expr = None
    for i, proto in reversed(list(enumerate(PROTOCOL_PRIORITY))):
        cond = lname.contains(proto)
        if proto == "rrc":
            cond = cond | F.coalesce(rrc_fields, F.lit(False))
        expr = F.when(cond, F.lit(i)) if expr is None else F.when(cond, F.lit(i)).otherwise(expr)
    return expr


def _first_keys(f: Column, keys: list[str]) -> Column:
    return F.coalesce(*[_truthy(f[k]) for k in keys])


def layer_facts(layers: Column | str = LAYERS) -> Column:
    """Every per-packet enrichment fact in two passes over the layers.

    ``transform`` evaluates each layer's candidates once (message type, ids, RRC
    direction, protocol rank); ``aggregate`` keeps the first non-null of each in stack
    order (and the best protocol rank).  One interpreted lambda pass per layer instead
    of one per fact, which is what makes enrichment cheap enough for capture-sized input.
    """
    layers = _c(layers)

    def per_layer(l: Column) -> Column:
        name, f = l["protocol_name"], l["fields"]
        return F.struct(
            name.alias("name"),
            F.when(name == "ngap", _first_keys(f, ["ngap.RAN_UE_NGAP_ID", "ngap.ngap.RAN_UE_NGAP_ID"])).alias("ran"),
            F.when(name == "s1ap", _first_keys(f, ["s1ap.ENB_UE_S1AP_ID", "s1ap.s1ap.ENB_UE_S1AP_ID", "s1ap.MME_UE_S1AP_ID", "s1ap.s1ap.MME_UE_S1AP_ID"])).alias("enb"),
            F.when(name.isin("nas-eps", "nas-5gs", "gsm_a.gm"), _first_keys(f, ["nas_eps.emm.imsi", "nas_5gs.mm.imsi", "e212.imsi"])).alias("imsi"),
            F.when(name.isin("nas-eps", "nas-5gs"), _first_keys(f, ["nas_eps.emm.guti", "nas_5gs.mm.5g_guti"])).alias("guti"),
            F.when(name.isin("nas-eps", "gsm_a.gm"), _first_keys(f, ["nas_eps.emm.m_tmsi", "gsm_a.tmsi"])).alias("tmsi"),
            F.when(name == "rrc", _first_keys(f, ["rrc.c_rnti", "lte-rrc.c_rnti", "nr-rrc.c_rnti"])).alias("rnti"),
            _layer_message_type(l).alias("mt"),
            F.when(F.lower(name).contains("rrc"), _truthy(f["rrc.direction"])).alias("rrc_dir"),
            _layer_rank(l).alias("rank"),
        )

    def nas_dir(x: Column) -> Column:
        lname = F.lower(x["name"])
        named = F.when(lname.contains("nas-5gs"), F.coalesce(decode_nas_5gs(x["mt"]), x["mt"])).otherwise(x["mt"])
        low = F.lower(named)
        up = F.lit(False)
        for w in UPLINK_NAS:
            up = up | low.contains(w)
        down = F.lit(False)
        for w in DOWNLINK_NAS:
            down = down | low.contains(w)
        return F.when(lname.contains("nas"), F.when(up, "UL").when(down, "DL"))

    string_facts = ["ran", "enb", "imsi", "guti", "tmsi", "rnti", "mt", "rrc_dir", "nas_dir"]
    init = F.struct(*[F.lit(None).cast("string").alias(n) for n in string_facts], F.lit(None).cast("int").alias("rank"))
    return F.aggregate(
        F.transform(layers, per_layer),
        init,
        lambda acc, x: F.struct(
            *[F.coalesce(acc[n], x[n]).alias(n) for n in string_facts if n != "nas_dir"],
            F.coalesce(acc["nas_dir"], nas_dir(x)).alias("nas_dir"),
            F.least(acc["rank"], x["rank"]).alias("rank"),
        ),
    )


def _ue_id_from(facts: Column) -> Column:
    return F.coalesce(
        facts["ran"], facts["enb"], F.concat(F.lit("IMSI:"), facts["imsi"]), F.concat(F.lit("GUTI:"), facts["guti"]),
        F.concat(F.lit("TMSI:"), facts["tmsi"]), F.concat(F.lit("RNTI:"), facts["rnti"]),
    )


def _direction_from(facts: Column) -> Column:
    rd = F.lower(facts["rrc_dir"])
    from_rrc = F.when(rd.contains("uplink") | rd.contains("ul"), "UL").when(rd.contains("downlink") | rd.contains("dl"), "DL")
    return F.coalesce(from_rrc, facts["nas_dir"])


def _protocol_from(facts: Column) -> Column:
    # a CASE chain, not element_at(array literal, idx): the optimizer's rewrite of that
    # form returned the last element for a NULL index
    expr = F.lit(None).cast("string")
    for i, n in reversed(list(enumerate(PROTOCOL_NAMES))):
        expr = F.when(facts["rank"] == i, F.lit(n)).otherwise(expr)
    return expr


def enrich_packets(layered: DataFrame) -> DataFrame:
    """Add ue_id, message_type, protocol, interface, direction and the flat field map.

    The facts struct is produced behind a one-element ``explode`` so it is computed
    once per packet and then only read (not re-inlined into every derived column).
    """
    once = F.struct(layer_facts().alias("facts"), lower_stack().alias("low"))
    with_facts = layered.select("*", F.explode(F.array(once)).alias("_once"))
    f = F.col("_once.facts")
    return with_facts.select(
        *[c for c in layered.columns],
        _ue_id_from(f).alias("ue_id"),
        f["mt"].alias("message_type"),
        _protocol_from(f).alias("protocol"),
        extract_interface(low=F.col("_once.low")).alias("interface"),
        _direction_from(f).alias("direction"),
        flatten_fields().alias("protocol_fields"),
    )


def layers_from_fields(packets: DataFrame) -> DataFrame:
    """Rebuild dissected layers from a flat field map (inverse of B8): keys are grouped by
    their first dot-separated part, in first-seen order; the layer name turns ``_`` back
    into ``-``.  Used to derive layered packets from a flat ``packets`` table."""
    from sigtrace.functions.fields import packet_key, with_fields

    df = with_fields(packets)
    prefixes = F.array_distinct(F.transform(F.map_keys("m"), lambda k: F.substring_index(k, ".", 1)))
    layers = F.transform(
        prefixes,
        lambda p: F.struct(
            F.replace(p, F.lit("_"), F.lit("-")).alias("protocol_name"),
            F.replace(p, F.lit("_"), F.lit("-")).alias("protocol_display"),
            F.map_from_entries(
                F.transform(
                    F.filter(F.map_entries("m"), lambda e: F.substring_index(e["key"], ".", 1) == p),
                    lambda e: F.struct(F.right(e["key"], F.length(e["key"]) - F.length(p) - 1).alias("key"), e["value"].alias("value")),
                )
            ).alias("fields"),
        ),
    )
    return df.select(
        *packet_key(df),
        "timestamp",
        "timestamp_iso",
        "length",
        F.transform(prefixes, lambda p: F.replace(p, F.lit("_"), F.lit("-"))).alias("protocol_stack"),
        layers.alias("protocol_layers"),
        "source_ip",
        "destination_ip",
        F.lit(None).cast("int").alias("source_port"),
        F.col("destination_port").cast("int").alias("destination_port"),
    )
