"""SQL surface and query-log operators (Q1-Q3).

``run_sql`` gives users every relational feature of Spark SQL (joins, windows,
set operations, grouping sets, CTEs) over the ``packets`` view, read-only.  The
query-log operators work on a *column* of texts, as projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.functions import codes


def validate_read_only(sql: str, spark: SparkSession | None = None) -> str:
    """Accept any single query; raise ``ValueError`` for commands, several statements and syntax errors.

    The text is read as a common table expression, where Spark's parser takes queries only; names are left to the run.
    """
    from pyspark.errors import AnalysisException, ParseException

    text = sql.strip().rstrip(";").rstrip()
    session = spark or SparkSession.active()
    try:
        session.sql(f"WITH _read_only AS (\n{text}\n) SELECT 1")
    except ParseException as e:
        raise ValueError(f"not one readable query: {e}") from e
    except AnalysisException:
        pass
    return text


def run_sql(spark: SparkSession, packets: DataFrame, sql: str, limit: int | None = None, view: str = "packets") -> DataFrame:
    """Q1: run any query over the ``packets`` view; ``limit`` caps the rows only when given.

    The view is there while the text is analysed (a query keeps what it was analysed with); a view of that name that
    the session had before is put back.
    """
    before = spark.table(view) if any(t.name == view and t.isTemporary for t in spark.catalog.listTables()) else None
    packets.createOrReplaceTempView(view)
    try:
        df = spark.sql(validate_read_only(sql, spark))
    finally:
        if before is None:
            spark.catalog.dropTempView(view)
        else:
            before.createOrReplaceTempView(view)
    return df if limit is None else df.limit(limit)


# FIXED VALUES: identifiers a UE filter can name, in order of precedence -> stored field.
# The first list holds the names in a JSON text (``name": "number``), the second those of a
# comparison (``name = 'number'``).
UE_KEYS_IN_JSON = {
    "enb_ue_s1ap_id": "s1ap.s1ap.ENB_UE_S1AP_ID",
    "mme_ue_s1ap_id": "s1ap.s1ap.MME_UE_S1AP_ID",
    "rlc-lte.ueid": "rlc_lte.rlc-lte.ueid",
    "m_tmsi": "nas-eps.emm.m_tmsi",
    "ran_ue_ngap_id": "ngap.RAN_UE_NGAP_ID",
}
UE_KEYS_COMPARED = {
    "s1ap.enb_ue_s1ap_id": "s1ap.s1ap.ENB_UE_S1AP_ID",
    "s1ap.mme_ue_s1ap_id": "s1ap.s1ap.MME_UE_S1AP_ID",
    "rlc-lte.ueid": "rlc_lte.rlc-lte.ueid",
    "m_tmsi": "nas-eps.emm.m_tmsi",
    "ngap.ran_ue_ngap_id": "ngap.RAN_UE_NGAP_ID",
}


def _named_numbers(low: Column, keys: dict[str, str], sign: str) -> Column:
    """Every ``key <sign> number`` of the lower-cased text, quotes and blanks aside, as ``key=number``."""
    names = "|".join(k.replace(".", "[.]") for k in keys)
    found = F.regexp_extract_all(low, F.lit(rf"(?:{names})[\"']?{sign}\s*[\"']?[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.translate(x, "\"'", ""), r"\s*[:=]\s*", "="))


def ue_filter_columns(text: Column) -> tuple[Column, Column]:
    """Q2 as expressions: (field, value) of the filter of highest precedence, else NULLs."""
    low = F.lower(text)
    # one extraction per form; which identifier wins is decided on the few strings found
    hits = F.concat(
        F.transform(_named_numbers(low, UE_KEYS_IN_JSON, ":"), lambda x: F.concat(F.lit("json "), x)),
        F.transform(_named_numbers(low, UE_KEYS_COMPARED, r"\s*="), lambda x: F.concat(F.lit("cmp "), x)),
    )
    order = [(f"json {k}", f) for k, f in UE_KEYS_IN_JSON.items()] + [(f"cmp {k}", f) for k, f in UE_KEYS_COMPARED.items()]
    names = F.array(*[F.lit(k) for k, _ in order])
    ranked = F.transform(hits, lambda h: F.struct(F.array_position(names, F.substring_index(h, "=", 1)).alias("r"), F.substring_index(h, "=", -1).alias("v")))
    best = F.aggregate(
        ranked,
        F.lit(None).cast("struct<r:bigint,v:string>"),
        lambda a, h: F.when(a.isNull() | (h["r"] < a["r"]), F.struct(h["r"].alias("r"), h["v"].alias("v"))).otherwise(a),
    )
    field = F.get(F.array(*[F.lit(f) for _, f in order]), (best["r"] - 1).cast("int"))
    return field, best["v"]


def ue_filter_in_sql(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Q2: detected UE-id field and value for every SQL text of a query log."""
    field, value = ue_filter_columns(F.col(text_col))
    return queries.withColumn("ue_field", field).withColumn("ue_value", value)


def _synonyms_in_order():
    """Synonym rows in dictionary order (first insertion), last value for repeated spellings."""
    return [(r[1], r[2], r[3]) for r in codes.DIM_MESSAGE_SYNONYM.rows]


def tag_message_types(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Q3: first synonym (dictionary order) contained in the lower-cased question ->
    canonical message name and message_type value.  A fixed ~74-way CASE, no join."""
    low = F.lower(F.col(text_col))
    found = F.lit(None).cast("struct<s:string,c:string,v:string>")
    for s, c, v in reversed(_synonyms_in_order()):
        found = F.when(low.contains(s), F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(v).alias("v"))).otherwise(found)
    tagged = questions.withColumn("_found", found)
    return tagged.withColumns({"matched": F.col("_found.s"), "canonical": F.col("_found.c"), "message_type_value": F.col("_found.v")}).drop("_found")


# ---------------------------------------------------------------------------
# Query logs derived from the packets table (so the operators scale with it)
# ---------------------------------------------------------------------------
def sql_log_from_packets(packets: DataFrame) -> DataFrame:
    """One SQL text per packet that filters on its second field, LIKE form or compare form."""
    from sigtrace.functions.fields import with_fields

    df = with_fields(packets)
    e = F.get(F.map_entries("m"), 1)  # second field (NULL when absent)
    like = F.concat(F.lit("SELECT * FROM packets WHERE protocol_fields_json LIKE '%\""), e["key"], F.lit('": "'), e["value"], F.lit("\"%'"))
    cmp = F.concat(F.lit("SELECT * FROM packets WHERE "), e["key"], F.lit(" = '"), e["value"], F.lit("'"))
    return df.where(F.size(F.map_keys("m")) >= 2).select(
        F.col("packet_number").alias("query_id"),
        F.when(F.col("packet_number") % 2 == 0, like).otherwise(cmp).alias("text"),
    )


def questions_from_packets(packets: DataFrame) -> DataFrame:
    """One natural-language question per packet naming its message type."""
    return packets.where(F.col("message_type").isNotNull()).select(
        F.col("packet_number").alias("question_id"),
        F.concat(F.lit("show "), F.col("message_type"), F.lit(" messages for ue "), F.coalesce("ue_id", F.lit("any"))).alias("text"),
    )
