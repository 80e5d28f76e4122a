"""Connected components of rasters and of general graphs.

A raster is cut into strips of rows. Within a strip a bounded Arrow kernel
labels pixels by the smallest index reachable; the strips' labels that touch
across a border form a small graph, whose components are found by star rounds.
So no image has to fit in one task, and no round works on pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.shared import by_batch, changes, discard, materialize, small

STRIP = 256
#: Places of an image's scan whose small components are resolved in one task.
SHARE = 1 << 17
SIMILAR = 0.045


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(image_id, node, root)`` of every node with an edge ``(image_id, u, v)``; root = smallest node.

    Large-star and small-star rounds alternate until the edges stay the same.
    """
    now = materialize(edges.filter("u <> v").select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            own = now.groupBy("image_id", F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return own.unionByName(now.select("image_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = now.unionByName(now.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, ["image_id", "u"]).filter("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(low, ["image_id", "u"]).select("image_id", pairs.alias("e")).select("image_id", "e.u", "e.v").filter("u <> v").distinct()
        now = materialize(small, "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def label_edges(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable node of each of ``n`` nodes: roots are hooked to smaller roots, then paths halved."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def touching(cells: pd.DataFrame, values: list[str], limit: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that are four-neighbours of one strip and alike: equal values, or squared distance under ``limit``."""
    starts = changes(cells, ["image_id", "strip"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cells))))
    x, y = cells["x"].to_numpy(np.int64), cells["y"].to_numpy(np.int64) % STRIP
    width = int(x.max()) + 2
    key = (group * (STRIP + 1) + y) * width + x
    order = np.argsort(key, kind="stable")
    ordered, held = key[order], cells[values].to_numpy()
    us, vs = [], []
    for step in (1, width):
        at = np.minimum(np.searchsorted(ordered, key + step), len(key) - 1)
        own = np.flatnonzero(ordered[at] == key + step)
        other = order[at[own]]
        alike = (held[own] == held[other]).all(axis=1) if limit is None else ((held[own] - held[other]) ** 2).sum(axis=1) < limit
        us.append(own[alike])
        vs.append(other[alike])
    return np.concatenate(us), np.concatenate(vs)


def components(cells: DataFrame, values: list[str], limit: float | None = None) -> DataFrame:
    """``cells(image_id, i, x, y, …)`` with ``comp``: the smallest ``i`` of the pixel's component.

    Four-neighbours belong together if all ``values`` are equal, or, given a
    ``limit``, if their squared distance is under it.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        roots = label_edges(len(pdf), *touching(pdf, values, limit))
        return pdf.drop(columns="strip").assign(local=pdf["i"].to_numpy()[roots])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema) + ", local long"
    local = materialize(by_batch(cells.withColumn("strip", F.floor(F.col("y") / STRIP)), ["image_id", "strip"], ["i"], label, schema), "strips")
    last = local.filter(F.col("y") % STRIP == STRIP - 1).select("image_id", "x", (F.col("y") + 1).alias("y"), F.col("local").alias("v"), *[F.col(c).alias(f"_{c}") for c in values])
    first = local.filter(F.col("y") % STRIP == 0).select("image_id", "x", "y", F.col("local").alias("u"), *values)
    if limit is None:
        alike = F.lit(True)
        for c in values:
            alike = alike & (F.col(c) == F.col(f"_{c}"))
    else:
        alike = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in values), F.lit(0.0)) < limit
    across = materialize(first.join(last, ["image_id", "x", "y"]).filter(alike).select("image_id", "u", "v"), "across")
    if across.isEmpty():  # no image is higher than a strip, or nothing goes on
        return local.withColumnRenamed("local", "comp").select(*cells.columns, "comp")
    roots = star_components(across)
    roots = small(materialize(roots.withColumnRenamed("node", "local"), "roots"), 100_000)
    return local.join(roots, ["image_id", "local"], "left").withColumn("comp", F.coalesce("root", "local")).select(*cells.columns, "comp")


def segment(pixels: DataFrame) -> DataFrame:
    """Components of opaque pixels whose neighbours are close in OKLab (strictly under ``SIMILAR``)."""
    from pixelweave.functions.color import with_oklab

    return components(with_oklab(pixels.filter("a <> 0")), ["l", "oa", "ob"], SIMILAR * SIMILAR)


def holes(mask: DataFrame) -> DataFrame:
    """``(image_id, comp, n)`` of unset regions of ``mask(image_id, i, x, y, on)`` that do not reach the edge."""
    sides = mask.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    open_cells = components(mask.filter(~F.col("on")), ["on"]).join(sides, "image_id")
    at_edge = F.max(((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("mx")) | (F.col("y") == F.col("my"))).cast("int"))
    return open_cells.groupBy("image_id", "comp").agg(F.count("*").alias("n"), at_edge.alias("edge")).filter("edge = 0").drop("edge")


def border_tally(labelled: DataFrame) -> DataFrame:
    """``(image_id, comp, pid, n)``: colours next to each component of ``labelled(image_id, x, y, pid, comp)``, with multiplicity."""
    from pixelweave.operators.stencil import FOUR, shifted

    own = labelled.select("image_id", "x", "y", "comp")
    other = labelled.select("image_id", "x", "y", F.col("comp").alias("beside"), "pid")
    met = shifted(own, FOUR).drop("d").join(other, ["image_id", "x", "y"]).filter("comp <> beside")
    return met.groupBy("image_id", "comp", "pid").agg(F.count("*").alias("n"))


def dominant_border(labelled: DataFrame) -> DataFrame:
    """``(image_id, comp, pid)``: the most frequent neighbouring colour, the lower one of ties."""
    return border_tally(labelled).groupBy("image_id", "comp").agg(F.max_by("pid", F.struct("n", -F.col("pid"))).alias("pid"))


def despeckle(cells: DataFrame, min_region: int | DataFrame, share: int = SHARE) -> DataFrame:
    """``cells(image_id, i, x, y, pid)`` with components of ``min_region`` pixels or fewer repainted.

    ``min_region`` is a number, or ``(image_id, min_region)`` by image. A small
    component takes the dominant colour around it, the lower of ties, as it is
    by then: small components are taken in scan order, so one depends on those
    small neighbours that come before it. They are dealt into shares of
    ``share`` places of the scan. All shares are resolved at once, with a guess
    at what they wait for in earlier ones (at first the colours as they were);
    shares whose guess was not what came out are resolved again, until every
    guess holds. That has one outcome, that of the scan, after as many rounds
    as a colour is handed on from share to share: never more than there are
    shares, and few in practice. What a component needs is its own border
    counts, not pixels.
    """
    from pixelweave.operators.stencil import FOUR, shifted

    part = lambda c: F.floor(F.col(c) / share)
    labelled = materialize(components(cells.select("image_id", "i", "x", "y", "pid"), ["pid"]), "labelled")
    sizes = labelled.groupBy("image_id", "comp").agg(F.count("*").alias("n"))
    tiny = sizes.filter(F.col("n") <= min_region) if isinstance(min_region, int) else sizes.join(min_region, "image_id").filter(F.col("n") <= F.col("min_region"))
    tiny = materialize(tiny.select("image_id", "comp"), "tiny")
    own = labelled.select("image_id", "x", "y", "comp").join(tiny, ["image_id", "comp"])
    other = labelled.select("image_id", "x", "y", F.col("comp").alias("beside"), F.col("pid").alias("color"))
    met = shifted(own, FOUR).drop("d").join(other, ["image_id", "x", "y"]).filter("comp <> beside").groupBy("image_id", "comp", "beside", "color").agg(F.count("*").alias("n"))
    before = tiny.select("image_id", F.col("comp").alias("beside"), F.lit(True).alias("tiny"))
    waits = F.coalesce(F.col("tiny"), F.lit(False)) & (F.col("beside") < F.col("comp"))
    inside = part("beside") == part("comp")
    todo = met.join(before, ["image_id", "beside"], "left").select("image_id", part("comp").alias("part"), "comp", "beside", "color", "n", (waits & inside).alias("waits"), (waits & ~inside).alias("outer"))
    todo = materialize(todo, "touch")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        """The colours of the small components of whole shares."""
        made: dict[tuple[int, int], int] = {}
        parts: list[int] = []
        tally: dict[int, int] = {}
        last = None
        for image, of, comp, beside, color, n, waits in zip(*(pdf[c].tolist() for c in ("image_id", "part", "comp", "beside", "color", "n", "waits"))):
            if (image, comp) != last:
                if last is not None:
                    made[last] = min(tally, key=lambda c: (-tally[c], c))
                last, tally = (image, comp), {}
                parts.append(of)
            if waits:
                color = made[image, beside]
            tally[color] = tally.get(color, 0) + n
        made[last] = min(tally, key=lambda c: (-tally[c], c))
        images, comps = zip(*made)
        return pd.DataFrame({"image_id": images, "part": parts, "comp": comps, "painted": list(made.values())})

    resolved = lambda rows: materialize(by_batch(rows, ["image_id", "part"], ["comp"], resolve, "image_id long, part long, comp long, painted int"), "painted")
    done = resolved(todo)
    guesses = materialize(todo.filter("outer").select("image_id", "part", "comp", "beside", F.col("color").alias("guess")), "guesses")
    while True:
        came = done.select("image_id", F.col("comp").alias("beside"), "painted")
        seen = materialize(guesses.join(came, ["image_id", "beside"]).withColumn("wrong", F.col("painted") != F.col("guess")), "guesses")
        discard(guesses)
        guesses = seen.select("image_id", "part", "comp", "beside", F.col("painted").alias("guess"))
        guesses.written_to = seen.written_to
        again = small(materialize(seen.filter("wrong").select("image_id", "part").distinct(), "again"), 100_000)
        if again.isEmpty():
            break
        told = guesses.withColumn("outer", F.lit(True))
        rows = todo.join(again, ["image_id", "part"], "left_semi").join(told, ["image_id", "part", "comp", "beside", "outer"], "left")
        more = resolved(rows.withColumn("color", F.coalesce("guess", "color")).drop("guess", "outer"))
        now = materialize(done.join(again, ["image_id", "part"], "left_anti").unionByName(more), "painted")
        discard(done, more)
        done = now
    discard(todo, guesses)
    out = labelled.join(done.drop("part"), ["image_id", "comp"], "left").withColumn("pid", F.coalesce("painted", "pid"))
    return out.select("image_id", "i", "x", "y", "pid")
