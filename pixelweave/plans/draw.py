"""SVG back to pixels: paths are filled by scanlines, in paint order, and packed as PNG.

Every path is cut into edges; an edge crosses the middle lines of the pixel rows
that it spans, and between every other crossing of a row (even-odd rule) lie
the pixels that are painted: those whose middle is inside. All of it is
relational, so neither a path nor an image has to fit in one task.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.color import channels_of
from pixelweave.functions.paths import path_rings
from pixelweave.functions.shared import materialize
from pixelweave.plans.layers import Model, paths_read, read_svgs
from pixelweave.sources import rasters


def path_edges(shapes: DataFrame) -> DataFrame:
    """``shapes(…, d)`` as one row per edge ``(…, x0, y0, x1, y1)``; rings are closed."""
    others = [c for c in shapes.columns if c != "d"]
    rings = shapes.select(*others, F.explode(path_rings(F.col("d"))).alias("ring"))
    onward = lambda i: F.get("ring", (i + 1) % F.size("ring"))
    each = rings.select(*others, F.explode(F.transform("ring", lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), onward(i)["x"].alias("x1"), onward(i)["y"].alias("y1")))).alias("e"))
    return each.select(*others, "e.*")


def crossings(shapes: DataFrame, sides: DataFrame) -> DataFrame:
    """``shapes(svg_id, …, d)`` as ``(svg_id, …, w, y, at)``: where their edges cross the middle line of each pixel row of ``sides(svg_id, w, h)``."""
    edges = path_edges(shapes).filter("y0 <> y1").join(sides, "svg_id")
    low, high = F.greatest(first_middle(F.least("y0", "y1")), F.lit(0)), F.least(first_middle(F.greatest("y0", "y1")), F.col("h")) - 1
    rows = edges.filter(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    at = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    return rows.withColumn("at", at).drop("x0", "y0", "x1", "y1", "h")


def first_middle(v):
    """The first row or column whose middle is not before ``v``."""
    return F.ceil(v - 0.5).cast("int")


def row_dots(crossed: DataFrame) -> DataFrame:
    """``crossed(svg_id, seq, …, w, y, at)`` as one row per pixel ``(svg_id, seq, …, w, y, x)`` between every other crossing.

    A row without ``seq`` and ``at`` stands for all pixels of its pixel row.
    All rows of a pixel row come into one partition before they are made
    pixels, and stay there for what is grouped by its pixels.
    """
    others = [c for c in crossed.columns if c != "at"]
    lines = crossed.repartition("svg_id", "y").groupBy(*others).agg(F.array_sort(F.collect_list("at")).alias("cuts"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1, F.lit(2)), lambda k: F.struct(F.greatest(first_middle(F.get("cuts", k - 1)), F.lit(0)).alias("a"), F.least(first_middle(F.get("cuts", k)), F.col("w")).alias("b")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("w").alias("b")))
    spans = lines.filter("seq is null or size(cuts) > 1").select(*others, F.explode(F.when(F.col("seq").isNull(), whole).otherwise(pairs)).alias("s")).filter("s.a < s.b")
    return spans.select(*others, F.explode(F.sequence(F.col("s.a"), F.col("s.b") - 1)).alias("x"))


def sides_of(sizes: DataFrame) -> DataFrame:
    return sizes.select("svg_id", F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))


def painted(shapes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(svg_id, x, y, seq)``: the last shape of ``shapes(svg_id, seq, d)`` that paints each pixel of ``sizes(svg_id, width, height)``.

    A pixel is painted where its middle is inside by the even-odd rule; a
    middle on a left or upper edge is inside, on a right or lower one not.
    """
    dots = row_dots(crossings(shapes.select("svg_id", "seq", "d").filter("seq is not null"), sides_of(sizes)))
    return dots.groupBy("svg_id", "x", "y").agg(F.max("seq").alias("seq"))


def draw_shapes(shapes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pixels(image_id, i, x, y, r, g, b, a)`` of ``shapes(svg_id, seq, d, color)``; what no shape paints is transparent.

    Every pixel row is there once for itself, below all shapes, so that pixels
    are made behind the only shuffle, of crossings.
    """
    shown = F.col("color").isNotNull()
    channels = {**{c: F.when(shown, v).otherwise(0) for v, c in zip(channels_of(F.col("color")), "rgb")}, "a": F.when(shown, 255).otherwise(0)}
    sides = sides_of(sizes)
    crossed = crossings(shapes.filter("seq is not null").select("svg_id", "seq", *[v.alias(c) for c, v in channels.items()], "d"), sides)
    blank = sides.filter("w >= 1 and h >= 1").select("svg_id", F.lit(None).cast(shapes.schema["seq"].dataType).alias("seq"), *[F.lit(None).cast("int").alias(c) for c in channels], "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.lit(None).cast("double").alias("at"))
    top = row_dots(crossed.unionByName(blank)).groupBy("svg_id", "w", "y", "x").agg(*[F.coalesce(F.max_by(c, "seq"), F.lit(0)).alias(c) for c in channels])
    return top.select(F.col("svg_id").alias("image_id"), (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("i"), "x", "y", *channels)


def draw_model(model: Model, sizes: DataFrame) -> DataFrame:
    """:func:`draw_shapes` of the visible layers."""
    colors = model.layers.filter("visible").select("svg_id", "layer_id", "color")
    return draw_shapes(model.shapes.join(colors, ["svg_id", "layer_id"]), sizes)


def draw(svgs: DataFrame) -> DataFrame:
    """The pixels of ``svgs(svg_id, svg)``: their flat paths at their own size, without transforms.

    Each text is read once, into a written table of its size and its paths.
    """
    read = materialize(read_svgs(svgs), "read-svgs")
    return draw_shapes(paths_read(read).withColumnRenamed("at", "seq"), read)


def png_bytes(width: int, height: int, data: bytes) -> bytes:
    """An RGBA buffer as a PNG file."""
    lines = np.zeros((height, 1 + 4 * width), np.uint8)  # a filter byte before each row
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, 4 * width)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png(images: DataFrame) -> DataFrame:
    """``rasters(image_id, width, height, data)`` with ``png``; null where a buffer does not fit its sides or has channels that are no bytes."""

    @F.pandas_udf("binary")
    def packed(width: pd.Series, height: pd.Series, data: pd.Series, error: pd.Series) -> pd.Series:
        return pd.Series([None if e is not None else png_bytes(int(w), int(h), d) for w, h, d, e in zip(width, height, data, error)])

    deep = F.when(rasters.depth_of(images) != 1, "channels are no bytes")
    return rasters.validated(images).withColumn("png", packed("width", "height", "data", F.coalesce("error", deep))).drop("error")


def render_png(svgs: DataFrame) -> DataFrame:
    """``(image_id, width, height, png)`` of ``svgs(svg_id, svg)``; SVGs without a size give no row."""
    return png(rasters.collect_rasters(draw(svgs))).select("image_id", "width", "height", "png")
