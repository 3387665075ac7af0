"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stellwerk.llm.batches import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """Add to each (u, v) the least neighbour of u, or u itself; the hot side of the join can be split."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v`` (bigint): the smallest node reachable.

    Alternates large-star (each larger neighbour is linked to the least one) and small-star (each
    smaller neighbour and the node itself are) until every edge leads to a root. Rounds grow with the
    logarithm of the nodes. Each round is a written table, so a lost executor costs one round at most.
    Self-loops give their node its own root; nulls are left out.
    """
    clean = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    now = stored(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node whose least neighbour is itself keeps its larger neighbours through the rows above.
        large = large.filter("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        loops = now.filter("u = v")
        now = stored(small.filter("u <> v").unionByName(loops).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.filter("u <> v").groupBy("u").agg(F.min("v").alias("root"))
    nodes = now.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("root"))
