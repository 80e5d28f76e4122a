"""Effective colours, edge density and the class of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.color import bucket
from pixelweave.operators.stencil import sobel

STEP, COVERAGE = 4, 0.93
LOGO_COLORS, LOGO_EDGES, PHOTO_COLORS = 6, 0.10, 24


def color_buckets(pixels: DataFrame, step: int = STEP) -> DataFrame:
    """``(image_id, bucket, n)`` over the opaque pixels of every ``step``-th row and column."""
    sample = pixels.filter((F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("a") != 0))
    return sample.groupBy("image_id", bucket(F.col("r"), F.col("g"), F.col("b")).alias("bucket")).agg(F.count("*").alias("n"))


def effective_colors(pixels: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(image_id, effective)``: how many of the most frequent buckets cover that share of the sample.

    An image without an opaque sample counts one. A window holds an image's
    buckets, 4096 at most.
    """
    counts = color_buckets(pixels)
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "bucket")
    ranked = counts.withColumns({"before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("image_id"))})
    found = ranked.groupBy("image_id").agg(F.sum(F.when(F.col("before") < F.ceil(F.round(F.col("total") * coverage, 9)), 1).otherwise(0)).alias("effective"))
    return pixels.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("effective", F.lit(1)).cast("int").alias("effective"))


def edge_density(pixels: DataFrame) -> DataFrame:
    """``(image_id, edge_density)``; 0 for images under 3 x 3."""
    found = sobel(pixels).groupBy("image_id").agg(F.avg(F.col("edge").cast("double")).alias("d"))
    return pixels.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("d", F.lit(0.0)).alias("edge_density"))


def class_of(effective, density):
    return F.when((effective <= LOGO_COLORS) & (density >= LOGO_EDGES), "Logo").when(effective >= PHOTO_COLORS, "Photo").otherwise("Illustration")


def classify(pixels: DataFrame) -> DataFrame:
    """``(image_id, effective, edge_density, class)`` of every image."""
    both = effective_colors(pixels).join(edge_density(pixels), "image_id")
    return both.withColumn("class", class_of(F.col("effective"), F.col("edge_density")))
