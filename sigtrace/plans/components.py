"""Connected components of an edge DataFrame by alternating large-star and small-star steps.

An edge ``(u, v)`` has ``u > v``.  A large-star step links every larger neighbour of a node
to the smallest node of its neighbourhood, a small-star step every smaller one; the edges
become a forest of stars around the smallest node of each component.  The steps move whole
neighbourhoods, not one label along one edge, so a chain shrinks geometrically whatever the
order of its nodes, and the loop ends when a round leaves the edges as they were - there is
no limit on rounds.

Each step is a min-aggregate with map-side combine and a join on the same key, where AQE can
split a hub's rows; a hub is never gathered in one group.  Lineage is cut every round with a
reliable ``checkpoint()``; one row (count and checksum) a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.session import ensure_checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``(node, component)`` where ``component`` is the smallest node of its component.

    ``edges`` holds undirected edges between comparable node keys; isolated nodes must appear
    as self-edges ``(n, n)``.  Edges with a null end are left out.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    whole = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    given = whole.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct().checkpoint()
    stars = given.where("u != v")
    before = None
    while True:
        stars = _small_star(_large_star(stars)).checkpoint()
        after = tuple(stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if after == before:
            break
        before = after
    nodes = given.select("u").union(given.select("v")).distinct()
    return nodes.join(stars, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
