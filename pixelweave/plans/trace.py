"""The whole trace: pixels and options in, SVG text and statistics out, a row per image."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.functions import params, text
from pixelweave.functions.color import channels_of, color_number, fill_color, hex_color, luma, oklab, oklab_to_bytes, reduce_bits, with_oklab
from pixelweave.functions.shared import materialize, small
from pixelweave.operators import blend, classify, components, contour, gradient, palette, stencil
from pixelweave.plans.layers import layers_from_svg
from pixelweave.sources import rasters



#: The options of each image: a table with a row per image.
SETTINGS = ("image_id", "class_override", "k", "lock_palette", "bw_mode", "detail", "gradients")


def setting_values(options: params.Options) -> list[Column]:
    """The options as columns."""
    lock = F.lit(None) if options.lock_palette is None else F.array(*[F.struct(*[F.lit(int(v)).alias(c) for c, v in zip("rgb", rgb)]) for rgb in options.lock_palette])
    made = {"class_override": F.lit(options.class_override).cast("string"), "k": F.lit(options.k).cast("int"), "lock_palette": lock.cast("array<struct<r:int,g:int,b:int>>"), "bw_mode": F.lit(options.bw_mode), "detail": F.lit(min(max(float(options.detail), 0.0), 1.0)), "gradients": F.lit(options.gradients)}
    return [c.alias(n) for n, c in made.items()]


def preclean(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """Fewer bits per channel; then, for images that are no logos and below the detail limit, the bilateral filter.

    ``classes(image_id, class, detail)`` says how for each image.
    """
    each = classes.select("image_id", params.significant_bits(F.col("detail")).alias("bits"), params.denoises(F.col("class"), F.col("detail")).alias("noisy"), params.sigma_color(F.col("detail")).alias("sigma"))
    reduced = pixels.join(small(each, 100_000), "image_id").withColumns({c: reduce_bits(F.col(c), F.col("bits")) for c in "rgb"})
    smooth = stencil.bilateral(reduced.filter("noisy").drop("bits", "noisy"), F.col("sigma"))
    return reduced.filter("not noisy").select(*pixels.columns).unionByName(smooth.select(*pixels.columns))


def gradient_regions(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted gradient regions as ``(image_id, z, definition, path, colors)``, and the pixels left to trace.

    Regions are read from the whole image. Each is grown by one pixel for its
    outline, and what it covers becomes transparent.
    """
    labelled = materialize(components.segment(pixels), "segments")
    opaque = pixels.filter("a <> 0").groupBy("image_id").agg(params.min_area(F.count("*")).alias("least"))
    large = labelled.groupBy("image_id", "comp").agg(F.count("*").alias("n")).join(opaque, "image_id").filter(F.col("n") >= F.col("least")).select("image_id", "comp")
    region = labelled.join(large, ["image_id", "comp"]).select("image_id", "comp", "i", "x", "y", "l", "oa", "ob")
    fits = materialize(gradient.detect(region), "fits")
    sides = stencil.image_sizes(pixels)
    grown = stencil.shifted(region.join(fits.select("image_id", "comp"), ["image_id", "comp"]).select("image_id", "comp", "x", "y"), [(0, 0), *stencil.FOUR]).join(sides, "image_id").filter(F.col("x").between(0, F.col("w") - 1) & F.col("y").between(0, F.col("h") - 1)).select("image_id", "comp", "x", "y").distinct()
    grown = materialize(grown, "grown")
    outlines = paths_of(contour.trace_rings(grown, ["image_id", "comp"]), ["image_id", "comp"])
    numbered = fits.join(outlines, ["image_id", "comp"]).withColumn("z", F.row_number().over(Window.partitionBy("image_id").orderBy("comp")) - 1).withColumn("id", F.concat(F.lit("g"), F.col("z").cast("string")))
    made = numbered.select("image_id", "z", text.gradient_definition(F.col("id"), F.col("p0"), F.col("p1"), F.col("stops")).alias("definition"), text.gradient_path(F.col("id"), F.col("d")).alias("path"), F.transform("stops", lambda s: s["color"]).alias("colors"))
    covered = grown.select("image_id", "x", "y", F.lit(True).alias("covered")).distinct()
    left = pixels.join(covered, ["image_id", "x", "y"], "left").withColumn("a", F.when(F.col("covered"), 0).otherwise(F.col("a"))).select(*pixels.columns)
    return made, left


def paths_of(rings: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, d)``: the rings of a region as one path; of curves if the rings have a ``corner_threshold``."""
    d = text.curved_subpath(F.col("pts"), contour.curve_commands("pts", F.col("corner_threshold"))) if "corner_threshold" in rings.columns else text.subpath(F.col("pts"))
    pieces = rings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ring_id", d.alias("d")))).alias("p"))
    return pieces.select(*keys, F.array_join(F.transform("p", lambda p: p["d"]), "").alias("d"))


def blended(cells: DataFrame, order: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``order`` after touching regions closer than ``limits(image_id, layer_difference)`` are merged.

    A merged region has its mean colour, whose number is its ``pid``, and the
    paint order of the colours that it is made of: its smallest.
    """
    labelled = materialize(components.components(cells.select("image_id", "i", "x", "y", "pid"), ["pid"]), "regions")
    colors = order.select("image_id", "pid", "z", *[v.alias(c) for v, c in zip(channels_of(F.col("color")), "rgb")])
    painted = labelled.join(colors, ["image_id", "pid"])
    ends = materialize(blend.merge_regions(painted.select("image_id", "x", "y", "comp", "r", "g", "b"), limits), "blended")
    number = color_number(F.col("r"), F.col("g"), F.col("b"))
    own = painted.select("image_id", "i", "x", "y", "comp", "z").join(ends.withColumn("pid", number), ["image_id", "comp"])
    made = own.groupBy("image_id", "pid").agg(F.min("z").alias("z"), F.first(fill_color(F.col("r"), F.col("g"), F.col("b"))).alias("color"))
    return own.select("image_id", "i", "x", "y", "pid"), made


def flat_paths(cells: DataFrame, order: DataFrame, least: DataFrame, epsilon: float = contour.EPSILON, corners: DataFrame | None = None) -> DataFrame:
    """``(image_id, z, comp, d, color)`` of the regions of equal ``pid`` with at least ``least(image_id, least)`` pixels.

    With ``corners(image_id, corner_threshold)`` outlines are curves that keep
    corners of so many degrees or more.
    """
    labelled = materialize(components.components(cells.select("image_id", "i", "x", "y", "pid"), ["pid"]), "regions")
    drawn = labelled.groupBy("image_id", "comp", "pid").agg(F.count("*").alias("n")).join(least, "image_id").filter(F.col("n") >= F.col("least")).drop("least")
    region = labelled.join(drawn.select("image_id", "comp"), ["image_id", "comp"])
    rings = contour.trace_rings(region.select("image_id", "comp", "x", "y"), ["image_id", "comp"], epsilon)
    if corners is not None:
        rings = rings.join(small(corners, 100_000), "image_id")
    outlines = paths_of(rings, ["image_id", "comp"])
    shapes = outlines.join(drawn, ["image_id", "comp"]).join(order.select("image_id", "pid", "z", "color"), ["image_id", "pid"])
    return shapes.select("image_id", "z", "comp", "d", "color")


def document(sides: DataFrame, body: DataFrame) -> DataFrame:
    """``(image_id, svg)`` from sizes and ``(image_id, z, comp, d, color)`` in paint order."""
    markup = text.shape_markup(F.col("d"), F.lit(""), F.col("color")).alias("markup")
    parts = body.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("z", "comp", markup))).alias("p"))
    inner = F.coalesce(F.array_join(F.transform("p", lambda p: p["markup"]), ""), F.lit(""))
    w, h = F.col("w").cast("string"), F.col("h").cast("string")
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('">'))
    return sides.join(parts, "image_id", "left").select("image_id", text.ensure_view_box(F.concat(head, inner, F.lit("</svg>")), F.col("w"), F.col("h")).alias("svg"))


def with_stats(svgs: DataFrame, colors: DataFrame, classes: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Results from SVGs, palettes ``(image_id, colors)`` and classes ``(image_id, class)``."""
    out = svgs.join(colors, "image_id", "left").join(classes.select("image_id", "class"), "image_id", "left")
    out = out.join(extra, "image_id", "left") if extra is not None else out.withColumn("again", F.lit(0))
    paths = text.count_paths(F.col("svg"))
    # Gradient paths count twice in path_count and once in path_count_distinct.
    stats = F.struct((paths + F.coalesce("again", F.lit(0))).cast("int").alias("path_count"), paths.alias("path_count_distinct"), F.coalesce("colors", F.array().cast("array<string>")).alias("palette"), F.col("class").alias("classified_as"), F.octet_length("svg").cast("long").alias("est_bytes"))
    return out.select("image_id", "svg", stats.alias("stats"))


def trace_bw(pixels: DataFrame, least: int = 1, epsilon: float = contour.EPSILON) -> DataFrame:
    """Dark opaque pixels in black; palette and class are fixed."""
    sides = materialize(stencil.image_sizes(pixels), "sides")
    dark = pixels.filter((F.col("a") != 0) & (luma(F.col("r"), F.col("g"), F.col("b")) < 128)).withColumn("pid", F.lit(0))
    order = sides.select("image_id", F.lit(0).alias("pid"), F.lit(0).alias("z"), F.lit("#000000").alias("color"))
    fixed = sides.select("image_id", F.array(F.lit("#000000")).alias("colors"), F.lit("Logo").alias("class"))
    return with_stats(document(sides, flat_paths(dark, order, sides.select("image_id", F.lit(least).alias("least")), epsilon)), fixed.select("image_id", "colors"), fixed.select("image_id", "class"))


def locked_palettes(settings: DataFrame) -> DataFrame:
    """``palette(image_id, pid, l, oa, ob)`` of the images whose settings lock one."""
    entries = settings.select("image_id", F.posexplode("lock_palette").alias("pid", "c"))
    return entries.select("image_id", "pid", *[c.alias(n) for c, n in zip(oklab(F.col("c.r"), F.col("c.g"), F.col("c.b")), palette.LAB)])


def bounded(pixels: DataFrame, longest: int = rasters.LONGEST_EDGE) -> DataFrame:
    """``pixels`` with images beyond the longest edge brought down to it; the others are left alone."""
    over = stencil.image_sizes(pixels).filter(F.greatest("w", "h") > longest).select("image_id")
    over = materialize(over, "oversized")
    if over.isEmpty():
        return pixels
    large = rasters.downsample(pixels.join(over, "image_id", "left_semi"), longest)
    return materialize(pixels.join(over, "image_id", "left_anti").unionByName(large), "bounded")


def trace(pixels: DataFrame, options: params.Options = params.DEFAULT, epsilon: float = contour.EPSILON, **how) -> DataFrame:
    """``(image_id, svg, stats)`` of every image of the pixel relation, all under the same options."""
    pixels = bounded(pixels)
    return trace_each(pixels, pixels.select("image_id").distinct().select("image_id", *setting_values(options)), epsilon=epsilon, **how)


def trace_paths(pixels: DataFrame, options: params.Options = params.DEFAULT, epsilon: float = contour.EPSILON, **how) -> DataFrame:
    """``(image_id, z, comp, d, color)``: the flat paths of every image in the order ``(z, comp)``, at its own size.

    Images are not brought down and no row holds a whole SVG, so they may be
    of any size where nothing is quantized; ``bw_mode`` and ``gradients`` have no such form.
    """
    if options.bw_mode or options.gradients:
        raise ValueError("paths are told of flat colours only")
    return trace_each(pixels, pixels.select("image_id").distinct().select("image_id", *setting_values(options)), epsilon=epsilon, whole=False, **how)


def trace_each(pixels: DataFrame, settings: DataFrame, measured: DataFrame | None = None, epsilon: float = contour.EPSILON, blend_layers: bool = False, curves: bool = False, whole: bool = True) -> DataFrame:
    """``(image_id, svg, stats)`` of every image under its own options, in one plan.

    ``settings`` has ``SETTINGS`` for each image, ``measured`` its
    ``(image_id, effective, class)`` if that is known. No image is beyond
    ``LONGEST_EDGE``. With an empty ``lock_palette`` nothing is quantized:
    every pixel keeps its colour. Images without an opaque pixel give an SVG
    without a path.

    ``blend_layers`` merges touching regions closer than the layer difference
    of the image's class and detail, ``curves`` draws outlines as curves that
    keep corners from its corner threshold on; both are our own contract.
    Without ``whole`` the flat paths are given as :func:`trace_paths` has them.
    """
    settings = materialize(settings.select(*SETTINGS), "settings")
    kinds = {c: F.coalesce(F.bool_or(e), F.lit(False)).alias(c) for c, e in {"dark": F.col("bw_mode"), "color": ~F.col("bw_mode"), "gradients": ~F.col("bw_mode") & F.col("gradients"), "guess": ~F.col("bw_mode") & F.col("class_override").isNull(), "free": ~F.col("bw_mode") & (F.size("lock_palette") == 0), "lock": ~F.col("bw_mode") & (F.size("lock_palette") > 0), "derive": ~F.col("bw_mode") & F.col("lock_palette").isNull()}.items()}
    some = settings.agg(*kinds.values(), F.bool_and(F.coalesce("bw_mode", F.lit(False))).alias("all_dark")).first()
    only = lambda df, images: df.join(images.select("image_id"), "image_id", "left_semi")
    # Where all images are such, no pixel has to meet the settings, which are no small table then.
    meant = pixels.filter("image_id is not null") if some["all_dark"] else only(pixels, small(settings.filter("bw_mode"), 100_000))
    dark = trace_bw(meant, epsilon=epsilon) if some["dark"] else None
    if not some["color"] and not whole:  # no image
        return flat_paths(pixels.withColumn("pid", F.lit(0)), settings.selectExpr("image_id", "0 pid", "0 z", "'' color"), settings.selectExpr("image_id", "1 least"))
    if not some["color"]:
        return dark if dark is not None else with_stats(document(stencil.image_sizes(pixels), flat_paths(pixels.withColumn("pid", F.lit(0)), settings.selectExpr("image_id", "0 pid", "0 z", "'' color"), settings.selectExpr("image_id", "1 least"))), settings.selectExpr("image_id", "cast(array() as array<string>) colors"), settings.selectExpr("image_id", "class_override class"))
    settings = settings.filter("not bw_mode")
    if dark is not None:
        pixels = only(pixels, small(settings, 100_000))
    sides = materialize(stencil.image_sizes(pixels), "sides")
    if measured is None:
        measured = classify.classify(pixels) if some["guess"] else classify.effective_colors(pixels).withColumn("class", F.lit(None).cast("string"))
    told = measured.select("image_id", "effective", F.col("class").alias("guessed")).join(settings, "image_id")
    classes = small(materialize(told.withColumn("class", F.coalesce("class_override", "guessed")).drop("guessed"), "classes"), 100_000)
    clean = materialize(preclean(pixels, classes.select("image_id", "class", "detail")), "clean")
    fitted = None
    if some["gradients"]:
        with_gradients = classes.filter("gradients")
        fitted, punched = gradient_regions(only(clean, with_gradients))
        fitted = materialize(fitted, "gradients")
        clean = materialize(punched.unionByName(clean.join(with_gradients.select("image_id"), "image_id", "left_anti")), "punched")
    cells, orders, colors = [], [], []
    if some["free"]:
        opaque = only(clean.filter("a <> 0"), classes.filter("size(lock_palette) = 0"))
        own = fill_color(F.col("r"), F.col("g"), F.col("b"))
        number = color_number(F.col("r"), F.col("g"), F.col("b"))
        cells.append(opaque.select("image_id", "i", "x", "y", number.alias("pid")))
        orders.append(opaque.select("image_id", number.alias("pid"), F.lit(0).alias("z"), own.alias("color")).distinct())
    if some["lock"] or some["derive"]:
        kept = only(clean, classes.filter("lock_palette is null or size(lock_palette) > 0")) if some["free"] else clean
        made = locked_palettes(settings)
        if some["derive"]:
            k = classes.filter("lock_palette is null").select("image_id", params.effective_k(F.col("class"), F.col("detail"), F.col("effective"), F.col("k")).alias("k"))
            made = made.unionByName(palette.quantize(with_oklab(only(kept, k).filter("a <> 0")).select("image_id", "i", "l", "oa", "ob"), k))
        made = materialize(made, "palette")
        assigned = palette.assign(kept, made)
        # The sentinel of transparent pixels sorts after every colour where ties go to the lower one.
        none = F.lit(1 << 20)
        full = kept.select("image_id", "i", "x", "y").join(assigned.select("image_id", "i", "pid"), ["image_id", "i"], "left").withColumn("pid", F.coalesce("pid", none))
        full = materialize(full, "full")
        smooth = components.despeckle(full, classes.select("image_id", params.min_region(F.col("detail")).alias("min_region"))).withColumnRenamed("pid", "painted")
        joined = full.join(smooth.select("image_id", "i", "painted"), ["image_id", "i"]).filter(F.col("pid") != none)
        painted = materialize(joined.withColumn("pid", F.when(F.col("painted") == none, F.col("pid")).otherwise(F.col("painted"))).drop("painted"), "cells")
        cells.append(painted)
        orders.append(palette.order_by_area(painted, made).select("image_id", "pid", "z", "color"))
        color = hex_color(*oklab_to_bytes(*[F.col(c) for c in palette.LAB]))
        colors.append(made.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pid", color.alias("c")))).alias("s")).select("image_id", F.transform("s", lambda s: s["c"]).alias("colors")))
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    nothing = F.array().cast("array<string>")
    used = sides.join(union(colors), "image_id", "left").select("image_id", F.coalesce("colors", nothing).alias("colors")) if colors else sides.select("image_id", nothing.alias("colors"))
    tracer = params.tracer_settings(F.col("class"), F.col("detail"))
    flat, order = union(cells), union(orders)
    if blend_layers:
        flat, order = blended(flat, order, small(classes.select("image_id", tracer["layer_difference"].alias("layer_difference")), 100_000))
    corners = classes.select("image_id", tracer["corner_threshold"].alias("corner_threshold")) if curves else None
    body = flat_paths(flat, order, classes.select("image_id", (tracer["filter_speckle"] * tracer["filter_speckle"]).alias("least")), epsilon, corners)
    if not whole:
        return body
    svgs = document(sides, body)
    if fitted is None:
        out = with_stats(svgs, used, classes)
    else:
        extra = fitted.groupBy("image_id").agg(F.count("*").cast("int").alias("again"), F.array_sort(F.collect_list(F.struct("z", "definition", "path", "colors"))).alias("s"))
        pieces = lambda c: F.array_join(F.transform("s", lambda s: s[c]), "")
        spliced = svgs.join(extra.select("image_id", "s"), "image_id", "left").select("image_id", F.when(F.col("s").isNull(), F.col("svg")).otherwise(text.splice(F.col("svg"), pieces("definition"), pieces("path"))).alias("svg"))
        both = used.join(extra.select("image_id", F.flatten(F.transform("s", lambda s: s["colors"])).alias("more")), "image_id", "left").select("image_id", F.concat("colors", F.coalesce("more", nothing)).alias("colors"))
        out = with_stats(spliced, both, classes, extra.select("image_id", "again"))
    return out if dark is None else out.unionByName(dark)


def web_stats(results: DataFrame, sides: DataFrame) -> DataFrame:
    """What an editor shows: class, path count, layers and size."""
    layers = layers_from_svg(results.select(F.col("image_id").alias("svg_id"), "svg")).groupBy("svg_id").agg(F.array_sort(F.collect_list(F.struct(F.col("layer_id").alias("id"), "color", "path_count"))).alias("layers"))
    out = results.join(layers, results["image_id"] == layers["svg_id"], "left").join(sides, "image_id")
    return out.select("image_id", F.col("stats.classified_as").alias("detected_class"), F.col("stats.path_count").alias("path_count"), F.coalesce("layers", F.array().cast("array<struct<id:string,color:string,path_count:bigint>>")).alias("layers"), F.col("w").alias("width"), F.col("h").alias("height"))


def variation_specs(base: params.Options = params.EDITOR) -> list[tuple[str, dict]]:
    """The editor's variations as names and patches of the options."""
    # Names, details and palette sizes.
    spread = (("Low detail · 8", 0.3, 8), ("Medium · 16", 0.55, 16), ("High detail · 32", 0.8, 32), ("Max · 64", 1.0, 64))
    forced = [("As logo", {"class_override": "Logo", "k": None}), ("As illustration", {"class_override": "Illustration", "detail": min(1.0, max(0.0, base.detail))})]
    return [(name, {"detail": detail, "k": k}) for name, detail, k in spread] + forced


def variation_table(bases: DataFrame) -> DataFrame:
    """``bases(…, detail)`` once per variation of the editor at that detail: ``(…, variant, name, detail, k, class_override)``."""
    others = [F.col(c) for c in bases.columns if c != "detail"]
    rows = []
    for n, (name, patch) in enumerate(variation_specs()):
        fixed = patch["class_override"] != "Illustration" if "class_override" in patch else True
        detail = F.lit(float(patch.get("detail", params.EDITOR.detail))) if fixed and "detail" in patch else params.unit(F.col("detail")) if not fixed else F.col("detail")
        rows.append(F.struct(F.lit(n).alias("variant"), F.lit(name).alias("name"), detail.alias("detail"), F.lit(patch.get("k")).cast("int").alias("k"), F.lit(patch.get("class_override")).cast("string").alias("class_override")))
    return bases.select(*others, F.inline(F.array(*rows)))


#: Columns of an options table besides ``variant`` and ``name``; all may be null.
OPTION_COLUMNS = "class_override string, k int, lock_palette array<struct<r:int,g:int,b:int>>, bw_mode boolean, photo_mode string, detail double, gradients boolean"


def option_rows(spark: SparkSession, options: params.Options, variations) -> DataFrame:
    """An options table ``(variant, name, error, …)`` from names and patches; a patch that does not fit has its ``error``."""
    rows = []
    for n, (name, patch) in enumerate(variations):
        try:
            o, error = replace(options, **patch), None
        except (TypeError, ValueError) as e:
            o, error = options, str(e)
        rows.append((n, name, error, o.class_override, o.k, None if o.lock_palette is None else [list(c) for c in o.lock_palette], o.bw_mode, o.photo_mode, float(o.detail), o.gradients))
    return spark.createDataFrame(rows, f"variant int, name string, error string, {OPTION_COLUMNS}")


def checked_options(table: DataFrame, base: params.Options = params.EDITOR) -> DataFrame:
    """An options table with nulls filled in from ``base`` and an ``error`` where a value is not allowed."""
    have = {c.split()[0]: c.split()[1] for c in OPTION_COLUMNS.replace(", ", ",").replace(",g:", ";g:").replace(",b:", ";b:").split(",")}
    kinds = {k: v.replace(";", ",") for k, v in have.items()}
    out = table
    for c, kind in kinds.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    plain = {"photo_mode": base.photo_mode, "bw_mode": base.bw_mode, "detail": base.detail, "gradients": base.gradients}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in plain.items()})
    bad = F.array_compact(F.array(
        F.when(~F.col("class_override").isin(*params.CLASSES), F.concat(F.lit("invalid options: class "), "class_override")),
        F.when(~F.col("photo_mode").isin(*params.PHOTO_MODES), F.concat(F.lit("invalid options: photo mode "), "photo_mode")),
        F.when(F.col("k") < 0, F.concat(F.lit("invalid options: k "), F.col("k").cast("string"))),
        F.when(F.isnan("detail"), F.lit("invalid options: detail")),
        F.when(F.exists("lock_palette", lambda c: F.coalesce(~(c["r"].between(0, 255) & c["g"].between(0, 255) & c["b"].between(0, 255)), F.lit(True))), F.lit("invalid options: palette")),
    ))
    found = F.when(F.size(bad) > 0, F.array_join(bad, "; "))
    error = F.coalesce(F.col("error"), found) if "error" in table.columns else found
    return out.withColumn("error", error).select("variant", "name", "error", *kinds)


def options_from_json(texts: DataFrame, column: str, base: params.Options = params.DEFAULT) -> DataFrame:
    """``texts(variant, name, <column>)`` as an options table: a JSON object each, missing fields from ``base``.

    What is no such object, or has a value that is not allowed, gets an
    ``error``; unknown fields are passed over.
    """
    schema = OPTION_COLUMNS.replace("array<struct<r:int,g:int,b:int>>", "array<array<int>>") + ", _bad string"
    read = texts.withColumn("o", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    shape = F.exists("o.lock_palette", lambda c: F.coalesce(F.size(c) != 3, F.lit(True)))
    error = F.when(F.col("o").isNull() | F.col("o._bad").isNotNull() | F.col(column).isNull(), "invalid options: not an object of options").when(shape, "invalid options: palette")
    lock = F.transform("o.lock_palette", lambda c: F.struct(F.get(c, 0).alias("r"), F.get(c, 1).alias("g"), F.get(c, 2).alias("b")))
    names = [c.split()[0] for c in OPTION_COLUMNS.split(", ")]
    return checked_options(read.select("variant", "name", error.alias("error"), *[(lock if n == "lock_palette" else F.col(f"o.{n}")).alias(n) for n in names]), base)


def options_from_editor(rows: DataFrame) -> DataFrame:
    """``rows(variant, name, class, colors, bw, detail, gradients)``, with the names of an editor, as an options table; ``auto`` is null."""
    kind = F.when(F.col("class") != "auto", F.initcap("class"))
    count = F.when(F.col("colors") != "auto", F.col("colors").cast("int"))
    return checked_options(rows.select("variant", "name", kind.alias("class_override"), count.alias("k"), F.col("bw").alias("bw_mode"), "detail", "gradients"), params.EDITOR)


def sweep(pixels: DataFrame, options: params.Options = params.EDITOR, variations=None, epsilon: float = contour.EPSILON) -> DataFrame:
    """Traces under every variation: ``(variant, name, image_id, svg, stats, error)``.

    ``variations`` are names and patches of ``options``, or an options table
    ``(variant, name, …)``. Every image has a row per variation; one that does
    not fit gives rows with its ``error`` and no SVG; if all are such, that is
    raised. It is one job: images meet the options table, each pair is an image
    of its own with its own settings, and all go through the trace together.
    Pixels are bounded and classified once.
    """
    spark = pixels.sparkSession
    if not isinstance(variations, DataFrame):
        variations = option_rows(spark, options, list(variations or variation_specs(options)))
    table = materialize(checked_options(variations, options), "options")
    if table.filter("error is null").isEmpty():
        raise ValueError("; ".join(r["error"] for r in table.select("error").limit(20).collect()) or "no variations")
    shared = materialize(bounded(pixels), "sweep-pixels")
    measured = materialize(classify.classify(shared).select(F.col("image_id").alias("of"), "effective", "class"), "measured")
    # One row per image and option; the options of an editor are few.
    numbers = [r["variant"] for r in table.select("variant").collect()]
    asked = measured.withColumn("variant", F.explode(F.array(*map(F.lit, numbers)))).join(small(table), "variant")
    pairs = materialize(asked.withColumn("image_id", F.monotonically_increasing_id()), "pairs")
    good = pairs.filter("error is null")
    each = shared.withColumnRenamed("image_id", "of").join(small(good.select("of", "image_id"), 100_000), "of").select(*shared.columns)
    settings = good.select("image_id", *SETTINGS[1:]).withColumn("detail", params.unit(F.col("detail")))
    made = trace_each(each, settings, good.select("image_id", "effective", "class"), epsilon)
    out = pairs.select("variant", "name", F.col("of"), "error", "image_id").join(made, "image_id", "left")
    return out.select("variant", "name", F.col("of").alias("image_id"), "svg", "stats", "error")
