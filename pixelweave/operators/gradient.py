"""Linear gradient detection in regions: aggregates, a window over bins, and gates.

All steps are relational over ``region(image_id, comp, i, x, y, l, oa, ob)``; the
greedy choice of stops works on an array of the region's 64 bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.color import hex_color, oklab_to_bytes, squared_distance
from pixelweave.functions.shared import materialize, small

MIN_PIXELS, MIN_RANGE, MIN_SPAN, MAX_STEP, MAX_RESIDUAL = 256, 0.02, 0.06, 0.4, 0.02
BINS, STOP_TOLERANCE, MOST_STOPS = 64, 0.02, 5
LAB = ("l", "oa", "ob")
REGION = ["image_id", "comp"]
#: Regions whose rows are broadcast to their pixels, and rows of their bins.
REGIONS, BIN_ROWS = 20_000, 200_000


def told(table: DataFrame, name: str, rows: int = REGIONS) -> DataFrame:
    """A table of a few rows per region, written and broadcast behind a count: pixels meet it where they lie, so a region may hold any share of them."""
    return small(materialize(table, name), rows)


def normal_equations(region: DataFrame) -> DataFrame:
    """The sums of a least-squares plane per channel, and the channels' ranges, in one aggregation."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    for c in LAB:
        sums |= {f"s_{c}": F.col(c), f"sx_{c}": x * F.col(c), f"sy_{c}": y * F.col(c)}
    return region.groupBy(*REGION).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()], *[(F.max(c) - F.min(c)).alias(f"range_{c}") for c in LAB])


def det3(m) -> F.Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def axes(sums: DataFrame) -> DataFrame:
    """``(image_id, comp, n, cx, cy, ux, uy)``: centroid and unit direction of the steepest channel.

    Regions under ``MIN_PIXELS``, flat ones and those without a slope are left
    out. A channel whose system is singular is dropped; of equal slopes the
    first channel wins.
    """
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    whole = det3(((n, sx, sy), (sx, sxx, sxy), (sy, sxy, syy)))
    slopes = []
    for k, c in enumerate(LAB):
        s, xs, ys = F.col(f"s_{c}"), F.col(f"sx_{c}"), F.col(f"sy_{c}")
        gx = det3(((n, s, sy), (sx, xs, sxy), (sy, ys, syy))) / whole
        gy = det3(((n, sx, s), (sx, sxx, xs), (sy, sxy, ys))) / whole
        slopes.append(F.when(F.abs(whole) >= 1e-9, F.struct(F.sqrt(gx * gx + gy * gy).alias("m"), F.lit(-k).alias("k"), gx.alias("gx"), gy.alias("gy"))))
    flat = (F.col("range_l") < MIN_RANGE) & (F.col("range_oa") < MIN_RANGE) & (F.col("range_ob") < MIN_RANGE)
    best = sums.filter((n >= MIN_PIXELS) & ~flat).withColumn("best", F.array_max(F.array(*slopes))).filter(F.col("best.m") > 1e-9)
    return best.select(*REGION, "n", (sx / n).alias("cx"), (sy / n).alias("cy"), (F.col("best.gx") / F.col("best.m")).alias("ux"), (F.col("best.gy") / F.col("best.m")).alias("uy"))


def projected(region: DataFrame, axis: DataFrame) -> DataFrame:
    """Region pixels with ``bin`` 0..63 along their axis, and the region's ``t0`` and ``t1``."""
    t = (F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy")
    along = region.join(told(axis, "axes"), REGION).withColumn("t", t)
    span = told(along.groupBy(*REGION).agg(F.min("t").alias("t0"), F.max("t").alias("t1")).filter(F.col("t1") - F.col("t0") >= 1e-3), "spans")
    share = F.round((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")), 9)
    return along.join(span, REGION).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))


def profile(binned: DataFrame) -> DataFrame:
    """Mean colour of every bin that has a pixel."""
    return binned.groupBy(*REGION, "bin").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in LAB])


def distance(p: str, q: str) -> F.Column:
    return F.sqrt(squared_distance([F.col(f"{p}{c}") for c in LAB], [F.col(f"{q}{c}") for c in LAB]))


def gates(binned: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """``(image_id, comp, span, max_step, residual, accepted)`` of each projected region; ``means`` is its profile if that is written already."""
    means = told(profile(binned), "profile", BIN_ROWS) if means is None else means
    order = Window.partitionBy(*REGION).orderBy("bin")
    steps = means.withColumns({f"b_{c}": F.lag(c).over(order) for c in LAB})
    steps = steps.groupBy(*REGION).agg(F.coalesce(F.max(distance("", "b_")), F.lit(0.0)).alias("max_step"), *[F.min_by(c, "bin").alias(f"f_{c}") for c in LAB], *[F.max_by(c, "bin").alias(f"e_{c}") for c in LAB])
    off = binned.select(*REGION, "bin", *LAB).join(means.select(*REGION, "bin", *[F.col(c).alias(f"m_{c}") for c in LAB]), [*REGION, "bin"])
    texture = off.groupBy(*REGION).agg(F.sqrt(F.avg(squared_distance([F.col(c) for c in LAB], [F.col(f"m_{c}") for c in LAB]))).alias("residual"))
    both = steps.join(texture, REGION).withColumn("span", distance("f_", "e_"))
    passed = (F.col("span") >= MIN_SPAN) & (F.col("max_step") <= MAX_STEP * F.col("span")) & (F.col("residual") <= MAX_RESIDUAL)
    return both.select(*REGION, "span", "max_step", "residual", passed.alias("accepted"))


def at_offset(stops: Column, off: Column) -> dict[str, Column]:
    """Piecewise-linear OKLab between the stops around an offset."""
    low = F.array_max(F.filter(stops, lambda s: s["off"] <= off))
    high = F.array_min(F.filter(stops, lambda s: s["off"] >= off))
    share = F.when(high["off"] > low["off"], (off - low["off"]) / (high["off"] - low["off"])).otherwise(0.0)
    return {c: low[c] + (high[c] - low[c]) * share for c in LAB}


def worst_bin(bins: Column, stops: Column) -> Column:
    """``(error, -bin, off, l, oa, ob)`` of the bin that the stops fit worst, the first of ties."""

    def fitted(b: Column) -> Column:
        off = (b["bin"] + 0.5) / BINS
        fit = at_offset(stops, off)
        error = F.round(F.sqrt(squared_distance([b[c] for c in LAB], [fit[c] for c in LAB])), 9)
        return F.struct(error.alias("error"), (-b["bin"]).alias("before"), off.alias("off"), *[b[c].alias(c) for c in LAB])

    return F.array_max(F.transform(bins, fitted))


def chosen_stops(means: DataFrame) -> DataFrame:
    """``(image_id, comp, stops)`` of profiles: the end colours, then greedily the worst bin, to tolerance or the limit.

    A region's profile is one array of at most ``BINS`` bins, so each choice is
    an expression on its own row.
    """
    point = lambda off, b: F.struct(F.lit(off).cast("double").alias("off"), *[b[c].alias(c) for c in LAB])
    out = means.groupBy(*REGION).agg(F.array_sort(F.collect_list(F.struct("bin", *LAB))).alias("bins"))
    out = out.withColumn("stops", F.array(point(0.0, F.element_at("bins", 1)), point(1.0, F.element_at("bins", -1))))
    for _ in range(MOST_STOPS - 2):
        out = out.withColumn("worst", worst_bin(F.col("bins"), F.col("stops")))
        more = F.array_sort(F.array_append("stops", F.struct("worst.off", *[F.col(f"worst.{c}").alias(c) for c in LAB])))
        out = out.withColumn("stops", F.when(F.col("worst.error") > STOP_TOLERANCE, more).otherwise(F.col("stops")))
    return out.select(*REGION, "stops")


def detect(region: DataFrame) -> DataFrame:
    """``fits(image_id, comp, p0, p1, stops)`` of the regions that are linear gradients; stops are ``(off, color)``."""
    axis = axes(normal_equations(region))
    binned = projected(region, axis)
    means = told(profile(binned), "profile", BIN_ROWS)
    good = told(gates(binned, means).filter("accepted").select(*REGION), "accepted")
    color = lambda s: hex_color(*oklab_to_bytes(*[s[c] for c in LAB]))
    stops = chosen_stops(means.join(good, REGION)).withColumn("stops", F.transform("stops", lambda s: F.struct(s["off"].alias("off"), color(s).alias("color"))))
    ends = binned.groupBy(*REGION).agg(*[F.first(c).alias(c) for c in ("cx", "cy", "ux", "uy", "t0", "t1")])
    point = lambda t: F.struct((F.col("cx") + F.col(t) * F.col("ux")).alias("x"), (F.col("cy") + F.col(t) * F.col("uy")).alias("y"))
    return stops.join(ends, REGION).select(*REGION, point("t0").alias("p0"), point("t1").alias("p1"), "stops")
