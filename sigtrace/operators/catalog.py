"""Dataset profiling and the field catalog.

The catalog is derived from the data itself: ``explode(map_entries(m))`` gives one
row per (packet, field), and every catalog view is an aggregation over it with a
partial (map-side) aggregate, so the shuffle carries distinct (type, field) pairs,
not packets.  Per-group "first k" selections use ``row_number() <= k``, which Spark
plans as a window group limit (top-k per task before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrace.functions.fields import with_fields


# ---------------------------------------------------------------------------
# profile
# ---------------------------------------------------------------------------
def table_profile(packets: DataFrame) -> DataFrame:
    """Row count, column count, first / last timestamp (one row)."""
    ncols = len([c for c in packets.columns if c != "m"])
    return packets.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(ncols).cast("bigint").alias("column_count"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
    )


def table_columns(packets: DataFrame) -> list[tuple[str, str]]:
    """C1 column list: (name, type) straight from the schema (no job)."""
    return [(f.name, f.dataType.simpleString()) for f in packets.schema.fields if f.name != "m"]


def top_protocols(packets: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` protocols by packets (ties broken by name)."""
    return (
        packets.where(F.col("protocol").isNotNull())
        .groupBy("protocol")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("protocol"))
        .limit(n)
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows and bytes per file of a Parquet dataset (hidden ``_metadata`` column), with
    the column count of the schema; total rows / files / bytes are one ``agg`` away."""
    ncols = len(df.columns)
    return (
        df.select("_metadata.file_path", "_metadata.file_size")
        .groupBy("file_path", "file_size")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("columns", F.lit(ncols))
    )


def inspect_head(packets: DataFrame, n: int = 10) -> DataFrame:
    """C4: first ``n`` packets (top-k by packet_number, no full sort)."""
    return packets.select("packet_number", "timestamp_iso", "protocol", "message_type").orderBy("packet_number").limit(n)


# ---------------------------------------------------------------------------
# Field catalog
# ---------------------------------------------------------------------------
def explode_fields(packets: DataFrame) -> DataFrame:
    """One row per (packet, field): packet_number, message_type, field, value."""
    df = with_fields(packets)
    return df.select("packet_number", "message_type", F.explode(F.map_entries("m")).alias("e")).select(
        "packet_number", "message_type", F.col("e.key").alias("field"), F.col("e.value").alias("value")
    )


def sample_per_message_type(packets: DataFrame, n: int) -> DataFrame:
    """The first ``n`` packets (by packet number) of every message type.

    ``row_number() <= n`` is planned as a window group limit: each task keeps at most
    ``n`` rows per message type before the shuffle, so a type holding a third of all
    packets never reaches one task whole.
    """
    w = Window.partitionBy("message_type").orderBy("packet_number")
    return (
        packets.where(F.col("message_type").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )


def field_catalog(packets: DataFrame, sample_per_type: int | None = None) -> DataFrame:
    """Fields per message type with the number of packets carrying them.

    Full scan by default; ``sample_per_type`` reproduces the reference's sampled
    catalog deterministically (first packets of each type, K19).
    """
    if sample_per_type:
        packets = sample_per_message_type(packets, sample_per_type)
    return (
        explode_fields(packets)
        .where(F.col("message_type").isNotNull())
        .groupBy("message_type", "field")
        .agg(F.count(F.lit(1)).alias("packets"))
    )


def field_samples(packets: DataFrame, k: int = 3, width: int = 50) -> DataFrame:
    """Up to ``k`` distinct sample values per field (first seen in packet order), cut to ``width``."""
    firsts = (
        explode_fields(packets)
        .select("field", F.substring(F.coalesce("value", F.lit("None")), 1, width).alias("sample"), "packet_number")
        .groupBy("field", "sample")
        .agg(F.min("packet_number").alias("first_packet"))
    )
    w = Window.partitionBy("field").orderBy("first_packet", "sample")
    return firsts.withColumn("sample_rank", F.row_number().over(w).cast("bigint")).where(F.col("sample_rank") <= k)


def fields_by_prefix(packets: DataFrame, shown: int = 10) -> DataFrame:
    """Per message type, fields grouped by prefix: first ``shown`` names and how many more."""
    fields = field_catalog(packets).select(
        "message_type",
        F.when(F.col("field").contains("."), F.split("field", r"\.", 2)[0]).otherwise(F.lit("other")).alias("prefix"),
        "field",
    )
    w = Window.partitionBy("message_type", "prefix").orderBy("field")
    counts = fields.groupBy("message_type", "prefix").agg(F.count(F.lit(1)).alias("n"))
    first = (
        fields.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= shown)
        .groupBy("message_type", "prefix")
        .agg(F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("fields"))  # at most `shown`
    )
    return first.join(counts, ["message_type", "prefix"]).select(
        "message_type", "prefix", "fields", F.greatest(F.col("n") - shown, F.lit(0)).cast("bigint").alias("more")
    )


def _norm3(c: Column) -> Column:
    """Lower-case, drop ``-``, ``_`` and ``.`` (the catalog's field-name normal form)."""
    return F.regexp_replace(F.lower(c), r"[-_.]", "")


def _norm3_lit(s: str) -> str:
    return s.lower().replace("-", "").replace("_", "").replace(".", "")


def match_fields(packets: DataFrame, query_field: str, message_type: str | None = None) -> DataFrame:
    """(message_type, field) whose normal form contains the query's, or the reverse."""
    qn = F.lit(_norm3_lit(query_field))
    cat = field_catalog(packets).select("message_type", "field")
    if message_type is not None:
        cat = cat.where(F.col("message_type") == message_type)
    fn = _norm3(F.col("field"))
    return cat.where(fn.contains(qn) | qn.contains(fn))


# FIXED VALUES: identity field tokens that add to a field-name match score.
IDENTITY_TOKENS = ["m_tmsi", "mme_ue_s1ap_id", "enb_ue_s1ap_id", "ran_ue_ngap_id", "ueid"]


def field_score(field: Column, query_field: str) -> Column:
    """C9 score of a candidate field name for a query name."""
    nq = _norm3_lit(query_field)
    fl = F.lower(field)
    nf = _norm3(field)
    parts = F.transform(F.split(fl, r"[._-]"), lambda p: F.regexp_replace(p, r"[-_.]", ""))
    score = (
        F.when(nf == F.lit(nq), 1000).otherwise(0)
        + F.when(nf.contains(F.lit(nq)), 100).otherwise(0)
        + F.when(F.array_contains(parts, F.lit(nq)), 200).otherwise(0)
        - F.when(fl.contains("flag"), 250).otherwise(0)
        - F.when(fl.endswith("flag"), 50).otherwise(0)
    )
    for tok in IDENTITY_TOKENS:
        score = score + F.when(fl.contains(tok), 25).otherwise(0)
    return score


def resolve_field(packets: DataFrame, query_field: str) -> DataFrame:
    """Best matching field per message type (highest score, then name)."""
    m = match_fields(packets, query_field).withColumn("score", field_score(F.col("field"), query_field))
    w = Window.partitionBy("message_type").orderBy(F.desc("score"), F.asc("field"))
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("message_type", "field", "score")


def field_families(packets: DataFrame) -> DataFrame:
    """Distinct field names with their family (s1ap / x2ap / rrc / nas) and UE-id flag."""
    keys = explode_fields(packets).select("field").distinct()
    k = F.col("field")
    lk = F.lower(k)
    family = (
        F.when(k.contains("s1ap.s1ap."), "s1ap")
        .when(k.contains("x2ap.x2ap."), "x2ap")
        .when(k.contains("rlc_lte.lte-rrc.") | k.contains("rlc_lte.rlc-lte."), "rrc")
        .when(lk.contains("nas"), "nas")
    )
    is_ue = (
        F.when(family.isin("s1ap", "x2ap"), k.contains("UE") & k.contains("ID"))
        .when(family == "rrc", lk.contains("ueid"))
        .when(family == "nas", lk.contains("tmsi") | lk.contains("imsi"))
        .otherwise(F.lit(False))
    )
    return keys.select("field", family.alias("family"), is_ue.alias("is_ue_id")).where(F.col("family").isNotNull())


def suggest_fields(packets: DataFrame, token: str, n: int = 6) -> DataFrame:
    """C11: up to ``n`` field names close to ``token`` (either-way containment, name order)."""
    tn = token.lower().replace("-", "").replace("_", "")
    keys = explode_fields(packets).select("field").distinct()
    fn = F.regexp_replace(F.lower("field"), r"[-_]", "")
    return keys.where(fn.contains(F.lit(tn)) | F.lit(tn).contains(fn)).orderBy("field").limit(n)


def distinct_message_types(packets: DataFrame) -> DataFrame:
    """Message types present."""
    return packets.where(F.col("message_type").isNotNull()).select("message_type").distinct()

