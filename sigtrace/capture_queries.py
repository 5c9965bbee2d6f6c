"""Registered queries over a stored table of two captures.

The driver's events become two captures with packet numbers of their own, written by ``write_packets`` and
read back by ``load_packets``.  UE ids are counters, so the same id in both captures is two UEs: each
operator must give what it gives for each capture alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.operators import callflow as T
from sigtrace.operators import correlate as G
from sigtrace.operators import lookup as V
from sigtrace.operators import measure as M
from sigtrace.operators import release as R
from sigtrace.oracle import callflow_sql as TS
from sigtrace.oracle import captures_sql as CS
from sigtrace.oracle import correlate_sql as GS
from sigtrace.oracle import lookup_sql as VS
from sigtrace.oracle import release_sql as RS
from sigtrace.registry import register_raw
from sigtrace.session import scratch_path
from sigtrace.sources.events_projection import packets_from_events
from sigtrace.sources.packets import hot_columns, load_packets, write_packets

_WRITTEN: dict[tuple[str, str], str] = {}


def split_captures(packets: DataFrame) -> DataFrame:
    """Every third packet is of the capture ``north``, the others of ``south``; each numbers its packets from 1 in the same order."""
    third = F.floor(F.col("packet_number") / 3).cast("bigint")
    north = F.col("packet_number") % 3 == 0
    own = F.when(north, third).otherwise(F.col("packet_number") - third)
    return packets.withColumns({"capture": F.when(north, "north").otherwise("south"), "packet_number": own})


def stored(packets: DataFrame, path: str) -> DataFrame:
    """``packets`` written as a table (parsed map, hot id columns) and loaded again."""

    def parsed(placed: DataFrame) -> DataFrame:
        held = placed.withColumn("fields", F.from_json("protocol_fields_json", "map<string,string>"))
        return held.select("*", *hot_columns(F.col("fields")))

    write_packets(packets, path, derived=parsed)
    return load_packets(packets.sparkSession, path)


def two_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of two captures, written once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = scratch_path(spark, "captures")
        stored(split_captures(packets_from_events(spark, sf_dir)), path)
        _WRITTEN[key] = path
    return load_packets(spark, _WRITTEN[key])


def register_by_capture(name: str, oracle: Callable[[], str]):
    def deco(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(two_captures(spark, sf_dir))

        run.__name__ = f"{name}_by_capture"
        run.__doc__ = fn.__doc__
        return register_raw(run.__name__, oracle)(run)

    return deco


def _alone(oracle: Callable[[], str]) -> Callable[[], str]:
    return lambda: CS.each_alone(oracle())


for _name, _oracle, _fn in [
    ("ue_session", TS.ue_session, lambda p: T.session_packets(p).select("capture", "session", "packet_number", "message_type", "ran", "amf")),
    ("session_summary", TS.session_summary, T.session_summary),
    ("ran_id_evolution", TS.ran_id_evolution, T.ran_id_evolution),
    ("session_phases", TS.session_phases, T.session_phases),
    ("session_message_counts", TS.session_message_counts, T.session_message_counts),
    ("session_steps", TS.session_steps, T.session_steps),
    ("enriched_call_flow", TS.enriched_call_flow, T.enriched_call_flow),
    ("handover_flow", TS.handover_flow, T.handover_flow),
    ("lte_call_flow", TS.lte_call_flow, T.lte_call_flow),
    ("release_events", RS.release_events, R.release_events),
    ("ue_release_detail", RS.ue_release_detail, R.ue_release_detail),
    ("ue_procedure_totals", RS.ue_procedure_totals, R.ue_procedure_totals),
    ("handover_failures_by_ue", RS.handover_failures_by_ue, R.handover_failures_by_ue),
    ("ue_has_message", RS.ue_has_message, lambda p: R.ue_has_message(p, R.ue_message_requests(p))),
    ("field_value_distinct", VS.field_value_distinct, lambda p: V.field_value_distinct(p, "pdn_ipv4")),
    ("field_value_best", VS.field_value_best, lambda p: V.field_value_best(p, "q-RxLevMin")),
    ("pdn_ip", VS.pdn_ip, V.pdn_ip),
    ("rsrp_rsrq", GS.rsrp_rsrq, M.rsrp_rsrq),
]:
    register_by_capture(_name, _alone(_oracle))(_fn)


@register_by_capture("ue_groups", CS.ue_groups)
def ue_groups_by_capture(p: DataFrame) -> DataFrame:
    """Groups of two captures meet in global identifiers only."""
    return G.ue_groups(p)


@register_by_capture("ue_group_stats", CS.ue_group_stats)
def ue_group_stats_by_capture(p: DataFrame) -> DataFrame:
    """G4 over both captures."""
    return G.ue_group_stats(G.ue_groups(p))


@register_by_capture("expand_by_correlation", CS.expand_by_correlation)
def expand_by_correlation_by_capture(p: DataFrame) -> DataFrame:
    """Packets of everything grouped with the smallest ENB id of capture ``north``."""
    target = G.smallest_id(p.where("capture = 'north'"), "enb_ue_s1ap_id").withColumn("capture", F.lit("north"))
    return G.expand_by_correlation(p, G.ue_groups(p), target).select("capture", "packet_number", "timestamp_iso", "protocol", "message_type")


@register_by_capture("resolve_rlc_ids", CS.resolve_rlc_ids)
def resolve_rlc_ids_by_capture(p: DataFrame) -> DataFrame:
    """ENB ids of each capture resolved within it."""
    v = F.col("fields")["s1ap.s1ap.ENB_UE_S1AP_ID"]
    requests = p.where(v.isNotNull()).select("capture", v.alias("ue_value")).distinct()
    return M.resolve_rlc_ids(p, G.ue_groups(p), requests)
