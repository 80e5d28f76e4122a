"""Regions of near colours merged, nearest first.

The contract is our own: two touching regions may merge if the Euclidean
distance of their byte colours is under the image's limit. In a round every
region names the open border with the smallest ``(distance, ids)``; borders named
by both sides are merged into the smaller id, with the mean colour by area. The
smallest border of an image is always named by both, so rounds end, and what
they give is that of merging one closest pair of mutual nearest at a time.
Regions and borders are tables of their own: no round works on pixels, and no
image is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.shared import discard, materialize

#: Distances are compared at so many places.
PLACES = 6


def borders(labelled: DataFrame) -> DataFrame:
    """``(image_id, u, v)``, ``u < v``: pairs of components with four-neighbouring cells."""
    own = labelled.select("image_id", "x", "y", F.col("comp").alias("u"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    moved = labelled.withColumn("d", steps).select("image_id", (F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), F.col("comp").alias("v"))
    met = own.join(moved, ["image_id", "x", "y"]).filter("u <> v")
    return met.select("image_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def merge_regions(labelled: DataFrame, limits: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``(image_id, comp, root, r, g, b)``: where each component of ``labelled(image_id, x, y, comp, r, g, b)`` ends, and that region's mean colour.

    ``limits(image_id, layer_difference)`` has each image's limit; an image
    without one, or with a null, keeps its regions.
    """
    nodes = materialize(labelled.groupBy("image_id", F.col("comp").alias("node")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"]), "blend-nodes")
    edges = materialize(borders(labelled).join(limits.filter("layer_difference is not null"), "image_id"), "blend-edges")
    roots = nodes.select("image_id", F.col("node").alias("comp"), F.col("node").alias("root"))
    first, written = nodes, []
    for _ in range(most_rounds):
        side = lambda k: nodes.select("image_id", F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in "rgb"])  # noqa: E731, B023
        off = sum(((F.col(f"u_{c}") - F.col(f"v_{c}")) * (F.col(f"u_{c}") - F.col(f"v_{c}")) for c in "rgb"), F.lit(0.0))
        told = edges.join(side("u"), ["image_id", "u"]).join(side("v"), ["image_id", "v"]).withColumn("d", F.round(F.sqrt(off), PLACES)).filter("d < layer_difference")
        named = F.explode(F.array("u", "v")).alias("node")
        best = told.select("image_id", named, F.struct("d", "u", "v").alias("e")).groupBy("image_id", "node").agg(F.min("e").alias("e"))
        both = best.groupBy("image_id", "e.u", "e.v").agg(F.count("*").alias("k")).filter("k = 2")
        pairs = materialize(both.select("image_id", F.col("v").alias("node"), F.col("u").alias("into")), "blend-pairs")
        if pairs.isEmpty():
            means = nodes.select("image_id", F.col("node").alias("root"), *[F.round(c).cast("int").alias(c) for c in "rgb"])
            return roots.join(means, ["image_id", "root"]).select("image_id", "comp", "root", "r", "g", "b")
        renamed = lambda df, c: df.join(pairs.withColumnsRenamed({"node": c, "into": "_into"}), ["image_id", c], "left").withColumn(c, F.coalesce("_into", c)).drop("_into")  # noqa: E731, B023
        mean = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"]
        new_nodes = materialize(renamed(nodes, "node").groupBy("image_id", "node").agg(F.sum("n").alias("n"), *mean), "blend-nodes")
        joined = renamed(renamed(edges, "u"), "v").filter("u <> v")
        new_edges = materialize(joined.select("image_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "layer_difference").distinct(), "blend-edges")
        roots = materialize(renamed(roots, "root"), "blend-roots")
        discard(edges, pairs, *written)
        if nodes is not first:
            discard(nodes)
        nodes, edges, written = new_nodes, new_edges, [roots]
    raise RuntimeError(f"regions did not settle in {most_rounds} rounds")
