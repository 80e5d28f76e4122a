"""Stencils over dense rasters: neighbours by window functions.

A first pass over rows (image, y) fetches left and right, a second over columns
(image, x) fetches the triples above and below. Both shuffle the pixel relation
once, whatever its size, and no image has to fit in one task. Transparent
pixels are rows too, so a raster is dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.color import luma, oklab, squared_distance

EDGE_AT = 48.0
#: The four neighbours of a pixel.
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def neighbours(pixels: DataFrame, values: dict[str, F.Column]) -> DataFrame:
    """``pixels`` with ``at``: the 3 x 3 structs of ``values`` row by row, null outside the raster."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    own = pixels.withColumn("c", F.struct(*[v.alias(k) for k, v in values.items()]))
    across = own.withColumn("three", F.array(F.lag("c").over(row), F.col("c"), F.lead("c").over(row)))
    nothing = F.array(*[F.lit(None)] * 3).cast(across.schema["three"].dataType)
    around = F.concat(F.coalesce(F.lag("three").over(column), nothing), F.col("three"), F.coalesce(F.lead("three").over(column), nothing))
    return across.withColumn("at", around).drop("c", "three")


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def bilateral(pixels: DataFrame, sigma: float | Column) -> DataFrame:
    """3 x 3 bilateral filter: weights are alpha times a Gaussian of the OKLab distance, means are of bytes.

    Transparent pixels stay and have no weight; images under 3 x 3 stay.
    ``sigma`` may be a column of the pixels, by image.
    """
    sigma = sigma if isinstance(sigma, Column) else F.lit(sigma)
    l, a, b = oklab(F.col("r"), F.col("g"), F.col("b"))
    met = neighbours(pixels, {"r": F.col("r"), "g": F.col("g"), "b": F.col("b"), "a": F.col("a"), "l": l, "oa": a, "ob": b}).join(image_sizes(pixels), "image_id")
    own = F.get("at", 4)
    lab = lambda c: (c["l"], c["oa"], c["ob"])
    seen = F.filter("at", lambda c: c.isNotNull() & (c["a"] > 0))
    weighed = F.transform(seen, lambda c: F.struct((c["a"] / 255.0 * F.exp(-squared_distance(lab(c), lab(own)) / (2.0 * sigma * sigma))).alias("w"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")))
    total = lambda f: F.aggregate("weighed", F.lit(0.0), lambda acc, x: acc + f(x))
    met = met.withColumn("weighed", weighed).withColumn("norm", total(lambda x: x["w"]))
    keep = (F.col("a") == 0) | (F.col("w") < 3) | (F.col("h") < 3) | (F.col("norm") <= 0)
    mean = lambda k: F.when(keep, F.col(k)).otherwise(F.round(F.round(total(lambda x: x["w"] * x[k]) / F.col("norm"), 9)).cast("int")).alias(k)
    return met.select("image_id", "i", "x", "y", *map(mean, "rgb"), "a")


def sobel(pixels: DataFrame) -> DataFrame:
    """``(image_id, i, x, y, magnitude, edge)`` of the inner pixels, on the luma of raw bytes."""
    met = neighbours(pixels, {"v": luma(F.col("r"), F.col("g"), F.col("b"))})
    v = [F.get("at", k)["v"] for k in range(9)]
    gx = (v[2] + v[5] * 2 + v[8]) - (v[0] + v[3] * 2 + v[6])
    gy = (v[6] + v[7] * 2 + v[8]) - (v[0] + v[1] * 2 + v[2])
    magnitude = F.sqrt(gx * gx + gy * gy)
    return met.filter(magnitude.isNotNull()).select("image_id", "i", "x", "y", magnitude.alias("magnitude"), (F.round(magnitude, 9) >= EDGE_AT).alias("edge"))


def shifted(mask: DataFrame, offsets) -> DataFrame:
    """Each row of a sparse mask once per offset, moved by it."""
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    return mask.withColumn("d", steps).withColumns({"x": F.col("x") + F.col("d.dx"), "y": F.col("y") + F.col("d.dy")})


def dilate(mask: DataFrame, width: int, height: int, steps: int = 1) -> DataFrame:
    """``(image_id, x, y)`` grown by ``steps`` over the four neighbours, within the raster."""
    out = mask.select("image_id", "x", "y")
    for _ in range(steps):
        out = shifted(out, [(0, 0), *FOUR]).filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select("image_id", "x", "y").distinct()
    return out


def corner_codes(mask: DataFrame) -> DataFrame:
    """``(image_id, x, y, code)`` of each grid corner that a set cell touches: bits TL, TR, BL, BR."""
    bits = shifted(mask.select("image_id", "x", "y"), [(1, 1), (0, 1), (1, 0), (0, 0)])
    bit = F.when((F.col("d.dx") == 1) & (F.col("d.dy") == 1), 1).when(F.col("d.dy") == 1, 2).when(F.col("d.dx") == 1, 4).otherwise(8)
    return bits.groupBy("image_id", "x", "y").agg(F.sum(bit).cast("int").alias("code"))
