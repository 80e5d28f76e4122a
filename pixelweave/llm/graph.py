"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import fresh_path, limited, materialize, remove_path


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Root of every node that has an edge: ``(node, root)``, root = smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014) alternate until
    the edge set stays the same. Each round is a written table in the shared
    folder, so a lost executor repeats one round at most. A node with very
    many neighbours is met only by ``min`` aggregates with map-side combining
    and by joins that adaptive execution can split.

    ``edges`` has the columns ``u`` and ``v``; self loops and repeated edges
    are allowed, an empty table gives an empty table.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, path = path, fresh_path(spark, "edges")
        now = materialize(small, "edges", path)
        remove_path(spark, last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def component_names(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, root, component_id)`` from ``nodes(node, least)`` and ``roots(node, root)`` of the nodes that have an edge.

    ``component_id`` is the smallest ``least`` of the component. The least of
    a component is aggregated and written on its own, so that its join with
    the members of a very large component can be dealt out by adaptive
    execution.
    """
    found = materialize(nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id")), "components")
    rooted = materialize(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    return rooted.join(limited(found), "root", "left").select("node", "root", F.coalesce("component_id", "least").alias("component_id"))
