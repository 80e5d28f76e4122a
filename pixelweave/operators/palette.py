"""Palettes: sampling, median cut, refinement, assignment and layer order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.functions.color import hex_color, oklab, oklab_to_bytes, squared_distance, with_oklab
from pixelweave.functions.shared import by_batch, changes, discard, materialize, numbered, small

SAMPLE, ROUNDS = 20_000, 8
LAB = ("l", "oa", "ob")


def locked(spark: SparkSession, colors, image_id: int = 0) -> DataFrame:
    """``palette(image_id, pid, l, oa, ob)`` of a caller's byte colours, in their order."""
    rows = spark.createDataFrame([(image_id, k, *map(int, c)) for k, c in enumerate(colors)], "image_id long, pid int, r int, g int, b int")
    return rows.select("image_id", "pid", *[c.alias(n) for c, n in zip(oklab(F.col("r"), F.col("g"), F.col("b")), LAB)])


def stride_sample(colors: DataFrame, cap: int = SAMPLE) -> DataFrame:
    """Every ``n div cap``-th opaque pixel of an image in index order, all of them up to twice the cap."""
    counted = numbered(colors, "image_id", ["i"], "ordinal")
    stride = F.greatest(F.floor(F.col("n") / cap), F.lit(1))
    return counted.filter(F.col("ordinal") % stride == 0).drop("ordinal", "n")


def box_statistics(colors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, widest axis (L, then a, of ties) and summed squared error of each box."""
    mean = colors.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in LAB], *[(F.max(c) - F.min(c)).alias(f"w_{c}") for c in LAB])
    off = squared_distance([F.col(c) for c in LAB], [F.col(f"m_{c}") for c in LAB])
    error = colors.join(mean, keys).groupBy(*keys).agg(F.sum(off).alias("error"))
    w = [F.col(f"w_{c}") for c in LAB]
    axis = F.when((w[0] >= w[1]) & (w[0] >= w[2]), "l").when(w[1] >= w[2], "oa").otherwise("ob")
    return mean.withColumn("axis", axis).join(error, keys)


def median_cut_step(colors: DataFrame) -> DataFrame:
    """``colors(image_id, i, l, oa, ob)`` with ``half``: 0 below the median of the widest axis, else 1."""
    axis = box_statistics(colors, ["image_id"]).select("image_id", "axis")
    value = F.when(F.col("axis") == "l", F.col("l")).when(F.col("axis") == "oa", F.col("oa")).otherwise(F.col("ob"))
    ranked = numbered(colors.join(axis, "image_id").withColumn("value", value), "image_id", ["value", "i"], "rank")
    return ranked.withColumn("half", F.when(F.col("rank") < F.floor(F.col("n") / 2), 0).otherwise(1)).drop("axis", "n", "rank", "value")


def with_nearest(colors: DataFrame, palette: DataFrame, few: bool | None = None) -> DataFrame:
    """``colors`` with the ``pid`` of the closest palette entry, the lowest of ties.

    A palette has 256 rows at most and becomes one array per image, so the
    colours are read once and not multiplied by the palette. Colours of images
    without a palette are dropped. ``few`` says that there are few palettes
    where that has been counted already.
    """
    entries = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pid", *LAB))).alias("entries"))
    entries = small(materialize(entries, "palettes")) if few is None else F.broadcast(entries) if few else entries
    d = lambda e: squared_distance([F.col(c) for c in LAB], [e[c] for c in LAB])
    least = F.array_min(F.transform("entries", lambda e: F.struct(d(e).alias("d"), e["pid"].alias("pid"))))
    return colors.join(entries, "image_id").withColumn("pid", least["pid"]).drop("entries")


def nearest(colors: DataFrame, palette: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``pid`` of the closest palette entry."""
    return with_nearest(colors, palette).select(*keys, "pid")


def assign(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Opaque pixels with ``pid``; distances are taken once per distinct colour."""
    opaque = pixels.filter("a <> 0")
    distinct = with_oklab(opaque.select("image_id", "r", "g", "b").distinct())
    return opaque.join(nearest(distinct, palette, ["image_id", "r", "g", "b"]), ["image_id", "r", "g", "b"])


def apply_palette(pixels: DataFrame, assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels repainted in palette colours; alpha stays and transparent pixels are untouched."""
    r, g, b = oklab_to_bytes(*[F.col(c) for c in LAB])
    paint = palette.select("image_id", "pid", r.alias("pr"), g.alias("pg"), b.alias("pb"))
    painted = assigned.select("image_id", "i", "pid").join(paint, ["image_id", "pid"])
    out = pixels.join(painted, ["image_id", "i"], "left")
    return out.select("image_id", "i", "x", "y", *[F.coalesce(F.col(f"p{c}"), F.col(c)).alias(c) for c in "rgb"], "a")


def order_by_area(assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """``(image_id, z, pid, area, color)``: entries by area, then pid; entries without a pixel too."""
    areas = assigned.groupBy("image_id", "pid").agg(F.count("*").alias("area"))
    color = hex_color(*oklab_to_bytes(*[F.col(c) for c in LAB]))
    rows = palette.withColumn("color", color).join(areas, ["image_id", "pid"], "left").withColumn("area", F.coalesce("area", F.lit(0)))
    return rows.select("image_id", (F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "pid")) - 1).alias("z"), "pid", "area", "color")


def lloyd_round(colors: DataFrame, palette: DataFrame, few: bool | None = None) -> DataFrame:
    """One refinement: means of the members, an empty entry keeps its place."""
    means = with_nearest(colors, palette, few).groupBy("image_id", "pid").agg(*[F.avg(c).alias(f"m_{c}") for c in LAB])
    return palette.join(means, ["image_id", "pid"], "left").select("image_id", "pid", *[F.coalesce(f"m_{c}", c).alias(c) for c in LAB])


def lloyd(colors: DataFrame, palette: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``rounds`` refinements; colours are computed once, palettes counted once, a round is one written table of a few rows."""
    colors = materialize(colors.select("image_id", *LAB), "lloyd-colors")
    palette = materialize(palette, "lloyd")
    few = palette.select("image_id").distinct().limit(2001).count() <= 2000
    for _ in range(rounds):
        before, palette = palette, materialize(lloyd_round(colors, palette, few), "lloyd")
        discard(before)
    discard(colors)
    return palette


# --- the derived palette: many images at a time, on a bounded sample of each ---

#: Errors are compared at so many places, so that equal ones tie whatever the order of a sum.
PLACES = 9


def box_errors(colors: np.ndarray, rows: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Summed squared distance of each box's colours from their mean; a box is a run of ``rows``."""
    run = np.cumsum(length) - length
    held = colors[rows[np.repeat(start - run, length) + np.arange(int(length.sum()))]]
    off = held - np.repeat(np.add.reduceat(held, run) / length[:, None], length, axis=0)
    return np.round(np.add.reduceat((off * off).sum(axis=1), run), PLACES)


def cut_boxes(colors: np.ndarray, starts: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median cut of all images at once: the rows in box order, and the boxes' starts and lengths, by image and position.

    In a round every image that has too few boxes cuts its worst one, the last
    of equal ones: by the widest axis, below and from the median. The place of
    the cut box is taken by the image's last box, the halves go to the end.
    """
    n_images, rows = len(starts), np.arange(len(colors))
    most = int(targets.max())
    begin, size, error = (np.zeros((n_images, most), kind) for kind in (np.int64, np.int64, float))
    begin[:, 0], size[:, 0] = starts, np.diff(np.append(starts, len(colors)))
    error[:, 0] = box_errors(colors, rows, begin[:, 0], size[:, 0])
    held = np.ones(n_images, np.int64)
    for _ in range(most - 1):
        able = size > 1
        image = np.flatnonzero((held < targets) & able.any(axis=1))
        if not len(image):
            break
        value = np.where(able[image], error[image], -1.0)
        worst = most - 1 - np.argmax(value[:, ::-1], axis=1)
        a, n = begin[image, worst], size[image, worst]
        run = np.cumsum(n) - n
        place = np.repeat(a - run, n) + np.arange(int(n.sum()))
        own = colors[rows[place]]
        axis = np.argmax(np.maximum.reduceat(own, run) - np.minimum.reduceat(own, run), axis=1)
        box = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((own[np.arange(len(own)), axis[box]], box))
        rows[place] = rows[place[order]]
        last = held[image] - 1
        for table in (begin, size, error):
            table[image, worst] = table[image, last]
        half = n // 2
        for at, start, length in ((last, a, half), (last + 1, a + half, n - half)):
            begin[image, at], size[image, at] = start, length
            error[image, at] = box_errors(colors, rows, start, length)
        held[image] += 1
    used = np.arange(most)[None, :] < held[:, None]
    return rows, begin[used], size[used]


def refine(colors: np.ndarray, image: np.ndarray, centers: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``centers[image, pid]`` (infinite where an image has fewer) moved to the means of their members, ``rounds`` times."""
    n_images, most = centers.shape[:2]
    for _ in range(rounds):
        near = np.concatenate([nearest_of(colors[k : k + 4096], centers[image[k : k + 4096]]) for k in range(0, len(colors), 4096)])
        cell = image * most + near
        n = np.bincount(cell, minlength=n_images * most)
        sums = np.stack([np.bincount(cell, weights=colors[:, c], minlength=n_images * most) for c in range(3)], axis=1)
        means = np.round(sums / np.maximum(n, 1)[:, None], PLACES + 3).reshape(centers.shape)
        centers = np.where((n > 0).reshape(n_images, most, 1), means, centers)
    return centers


def nearest_of(colors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest of each colour's own centers, the first of ties."""
    off = np.where(np.isinf(centers), 1e6, colors[:, None, :] - np.where(np.isinf(centers), 0.0, centers))
    return np.round((off * off).sum(axis=2), PLACES + 3).argmin(axis=1)


def quantize(colors: DataFrame, k: DataFrame) -> DataFrame:
    """``palette(image_id, pid, l, oa, ob)`` from opaque ``colors(image_id, i, l, oa, ob)`` and ``k(image_id, k)``.

    On each image's stride sample (under twice ``SAMPLE`` rows): median cut,
    then ``ROUNDS`` refinements; the images of a batch go through every round
    together. ``k`` is clamped to [1, sample size]; duplicate and empty entries
    stay, as positions are keys.
    """
    sample = stride_sample(colors).join(small(k), "image_id").select("image_id", "i", *LAB, "k")

    def derive(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = changes(pdf, ["image_id"])
        n = np.diff(np.append(starts, len(pdf)))
        values, image = pdf[list(LAB)].to_numpy(), np.repeat(np.arange(len(starts)), n)
        targets = np.minimum(np.maximum(pdf["k"].to_numpy(np.int64)[starts], 1), n)
        rows, begin, size = cut_boxes(values, starts, targets)
        order = np.argsort(begin, kind="stable")  # boxes cover all rows
        mean = np.zeros((len(begin), 3))
        mean[order] = np.add.reduceat(values[rows], begin[order]) / size[order, None]
        centers = np.full((len(starts), int(targets.max()), 3), np.inf)
        of, pid = image[begin], np.concatenate([np.arange(t) for t in np.bincount(image[begin], minlength=len(starts))])
        centers[of, pid] = np.round(mean, PLACES + 3)
        found = refine(values, image, centers)[of, pid]
        return pd.DataFrame({"image_id": pdf["image_id"].to_numpy()[starts][of], "pid": pid, **{c: found[:, j] for j, c in enumerate(LAB)}})

    return by_batch(sample, ["image_id"], ["i"], derive, "image_id long, pid int, l double, oa double, ob double")
