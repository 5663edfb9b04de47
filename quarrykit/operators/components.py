"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) with u > v: every node links its neighbours (large: the greater ones) to the least of them.

    The minimum is a map-side combinable aggregate, so a hub's neighbours are never gathered in one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").dropDuplicates(["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge: component is the least node it is linked with.

    `edges` has u and v, in any order; self-edges and nulls are passed over. Rounds end when a star step changes nothing, which
    takes O(log^2 n) of them. Each round is cut by a checkpoint in the shared folder."""
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates()
    e = cut_lineage(e)
    seen = None
    for _ in range(max_rounds):
        e = cut_lineage(_stars(_stars(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).dropDuplicates()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
