"""The sink's and the scans' plans do each piece of work once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigtrace.operators import enrich as B
from sigtrace.plans.ordered import heavy_keys
from sigtrace.sources.packets import HOT_ALIASES, hot_columns, load_packets, write_packets


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_columns_are_lookups_without_array_functions(spark):
    ids = HOT_ALIASES["hot_ran"]
    rows = [(1, {ids[0]: "7", ids[1]: "7"}), (2, {ids[0]: "7", ids[2]: "8"}), (3, {ids[2]: "9"}), (4, {ids[1]: None}), (5, None)]
    df = spark.createDataFrame(rows, "n int, fields map<string,string>").select("n", *hot_columns(F.col("fields")))
    assert "array_distinct" not in df._jdf.queryExecution().analyzed().toString()
    got = [(r.hot_ran, r.hot_ids_differ) for r in df.orderBy("n").collect()]
    assert got == [("7", False), ("7", True), ("9", False), (None, False), (None, False)]


def test_derived_columns_are_added_behind_the_sort(spark, tmp_path):
    df = spark.range(40).select(
        (40 - F.col("id")).alias("packet_number"), F.lit("a").alias("capture"), F.timestamp_seconds(F.col("id") % 2 * 86400).alias("timestamp_hour")
    )
    write_packets(df.repartition(3), str(tmp_path / "t"), derived=lambda d: d.withColumn("twice", F.col("packet_number") * 2))
    back = load_packets(spark, str(tmp_path / "t"))
    assert back.where("twice = 2 * packet_number").count() == 40
    for f in back.select("_metadata.file_path").distinct().collect():
        numbers = [r.packet_number for r in spark.read.parquet(f.file_path).collect()]
        assert numbers == sorted(numbers)


def test_rows_reach_the_quantiles_summed(spark):
    df = spark.range(6000).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("o")).unionByName(spark.range(5).select(F.lit(None).cast("string").alias("k"), F.lit(None).cast("long").alias("o")))
    heavy = heavy_keys(df, "k", "o", 2000)
    assert "keys=[k" in _plan(heavy) and "_v" in _plan(heavy)
    got = {r["_h_k"]: r["_cuts"] for r in heavy.collect()}
    assert set(got) == {"0", "1"} and all(c == sorted(set(c)) and len(c) > 900 for c in got.values())


def test_layer_names_and_interface_are_worked_out_once(spark):
    rows = [(1, 0.5, "t", 60, "10.0.0.1", "10.0.0.2", 38412, '{"ngap.ngap.procedureCode": "15", "nas_5gs.mm.message_type": "0x41"}')]
    p = spark.createDataFrame(rows, "packet_number long, timestamp double, timestamp_iso string, length int, source_ip string, destination_ip string, destination_port int, protocol_fields_json string")
    layered = B.layers_from_fields(p)
    e = B.enrich_packets(layered)
    assert layered._jdf.queryExecution().analyzed().toString().count("map_from_entries") == 1
    assert e._jdf.queryExecution().analyzed().toString().count("transform(protocol_stack") <= 1
    r = e.first()
    assert (r.protocol_stack, r.interface, r.protocol) == (["ngap", "nas-5gs"], "N2", "NAS_5GS")
