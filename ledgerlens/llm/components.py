"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every node in
    ``links`` (``a``, ``b``), by alternating star contraction.

    Each round links every node's larger neighbours to its smallest neighbour,
    then its smaller neighbours to the smallest of them, until all links point
    at the smallest node of their component; the number of rounds grows with
    the logarithm of the longest path.  Minima are aggregated before the
    shuffle, written and joined back, so a hub's links are never gathered and its
    partition can be split; each round is a written table too, so a lost executor
    repeats one round at most."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = shared(edges, "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before or not state["n"]:
            break
        before = state["n"], state["h"]
        both = edges.union(edges.select("v", "u"))
        low = shared(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = shared(small.distinct(), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
