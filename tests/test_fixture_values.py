"""Values FIXTURES.md §3 lists for sf0.01 (both engines agreed on them when the survey was written)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def packets(spark):
    from sigtrace.sources.events_projection import packets_from_events

    return packets_from_events(spark, SF)


def test_projection_cardinalities(packets):
    from sigtrace.operators.listing import unique_ue_count

    assert packets.count() == 10000
    assert unique_ue_count(packets).collect()[0].unique_ues == 449
    assert packets.where(F.col("message_type") == "measurementReport").count() == 493


def test_ue_groups(packets):
    from sigtrace.operators.correlate import ue_group_stats, ue_groups

    s = ue_group_stats(ue_groups(packets)).collect()[0]
    assert (s.total_groups, s.total_identifiers) == (25, 175)


def test_session_phases(packets):
    from sigtrace.operators.callflow import session_phases

    got = {r.phase: (r.n, r.msgs) for r in session_phases(packets).groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.sum("messages").alias("msgs")).collect()}
    assert got == {
        "Registration and Attach": (766, 2700),
        "Handover Procedure": (452, 2320),
        "Path Switch": (317, 1136),
        "PDU Session Establishment": (144, 490),
    }


def test_release_and_pdn_counts(packets):
    from sigtrace.operators.lookup import field_values
    from sigtrace.operators.release import release_stats

    assert release_stats(packets).collect()[0].total_releases == 1365
    assert field_values(packets, "pdn_ipv4").count() == 319


def test_chunked_scans_independent_of_chunk_size(packets):
    """Cut every session / UE into ~100 chunks: results must equal the default (one chunk)."""
    from sigtrace.operators import callflow as T

    for fn in (T.session_phases, T.ran_id_evolution, T.enriched_call_flow, T.handover_flow):
        a = sorted(tuple(r) for r in fn(packets).collect())
        b = sorted(tuple(r) for r in fn(packets, chunk_size=97).collect())
        assert a == b, fn.__name__
        c = sorted(tuple(r) for r in fn(packets, chunk_size=5).collect())  # rows a chunk: every session is a heavy key
        assert a == c, fn.__name__
