"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.session import discard, materialize


def _toward_min(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (u, v: long) its root: the smallest node reachable. Nodes without edges aren't listed.

    Each round is two group-and-join steps over the edges, so a node with very many neighbours is split by a skew
    join; every round's table is written to the shared folder. The count and a checksum of the edges decide the end.
    """
    state = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _toward_min(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        after = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialize(after.where("u <> v").distinct(), "cc")
        discard(state)
        state = after
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
