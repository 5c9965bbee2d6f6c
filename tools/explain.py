"""Print the formatted physical plan of registered operators over a written packets table.

usage: python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    from sigtrace.registry import OPERATORS, load_all
    from sigtrace.session import local_session, scratch_path
    from sigtrace.sources.events_projection import packets_from_events
    from sigtrace.sources.schema import HOT_KEYS

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    load_all()
    spark = local_session()
    path = scratch_path(spark, "explain-packets")
    p = packets_from_events(spark, sf)
    p = p.select("*", F.from_json("protocol_fields_json", "map<string,string>").alias("fields"))
    p.select("*", *[F.col("fields")[k].alias(n) for n, k in HOT_KEYS.items()]).write.parquet(path)
    packets = spark.read.parquet(path)
    for name in args:
        print(f"===== {name}")
        OPERATORS[name](packets).explain("formatted")


if __name__ == "__main__":
    main()
