"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.llm.common import written


def _state(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(found)


def star_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node in ``links`` (``u``, ``v`` long).

    Large star ties every larger neighbour of a node to the smallest one, small star every smaller
    neighbour; when nothing changes each node hangs on its component's minimum. A round is two
    groupings with map-side minima joined back to the edges (a hub's edges can be split), written to
    the shared folder. Links with a null end and links to oneself are left out.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # here every u is larger than its v
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
