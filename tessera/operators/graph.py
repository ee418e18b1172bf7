"""Connected components of an edge list.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every round is a grouped min and
a join, converges in O(log^2 n) rounds, and each vertex ends pointing at the
smallest vertex id of its component.  Each round's edge table is written to
the shared checkpoint folder and the one before it is deleted.  Both sides of
the joins grow with the graph, so they are shuffled: what a round broadcasts
would pass through the driver, round after round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(m.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # orient every edge from the larger to the smaller endpoint
    o = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = o.groupBy("u").agg(F.min("v").alias("m"))
    out = o.join(m.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .unionByName(m.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(vertex, component)`` for every vertex that appears in an edge;
    ``component`` is the smallest vertex id of its component.  Runs until the
    edge set no longer changes."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v")) \
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = materialize(e, "cc")
    prev = None
    while True:
        new = materialize(_small_star(_large_star(e)), "cc")
        discard(e)
        e = new
        # converged when the edge set no longer changes
        sig = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        key = (sig["n"], sig["h"])
        if key == prev:
            break
        prev = key
    verts = e.select(F.col("u").alias("vertex"), F.col("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")))
    return verts.groupBy("vertex").agg(F.min("component").alias("component"))
