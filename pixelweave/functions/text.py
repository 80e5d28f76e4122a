"""SVG text pieces as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coordinate(value: Column) -> Column:
    """A whole number where that is within 1e-4, else two decimals, half to even."""
    whole = F.round(value)
    return F.when(F.abs(value - whole) < 1e-4, whole.cast("long").cast("string")).otherwise(F.format_string("%.2f", F.bround(value.cast("double"), 2)))


def subpath(points: Column) -> Column:
    """``Mx yLx y…Z`` of an array of points; empty for none."""
    pairs = F.transform(points, lambda p: F.concat(coordinate(p["x"]), F.lit(" "), coordinate(p["y"])))
    return F.when(F.size(points) == 0, F.lit("")).otherwise(F.concat(F.lit("M"), F.array_join(pairs, "L"), F.lit("Z")))


def curved_subpath(points: Column, sides: Column) -> Column:
    """A ring's ``M``, then a line or a cubic per side (see ``contour.curve_commands``), then ``Z``; a plain path where there are no sides."""
    pair = lambda p: F.concat(coordinate(p["x"]), F.lit(" "), coordinate(p["y"]))
    pieces = F.transform(sides, lambda s: F.when(s["corner"], F.concat(F.lit("L"), pair(s["p"]))).otherwise(F.concat(F.lit("C"), pair(s["c1"]), F.lit(" "), pair(s["c2"]), F.lit(" "), pair(s["p"]))))
    first = F.get(points, F.lit(0))
    return F.when(F.size(sides) == 0, subpath(points)).otherwise(F.concat(F.lit("M"), pair(first), F.array_join(pieces, ""), F.lit("Z")))


def escape_attribute(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def shape_markup(d: Column, transform: Column, color: Column) -> Column:
    moved = F.when(F.coalesce(transform, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(' transform="'), escape_attribute(transform), F.lit('"')))
    return F.concat(F.lit('<path d="'), escape_attribute(d), F.lit('" fill="'), color, F.lit('"'), moved, F.lit("/>"))


def stop_elements(stops: Column) -> Column:
    """``<stop>`` elements of an array of ``(off, color)``."""
    return F.array_join(F.transform(stops, lambda s: F.concat(F.lit('<stop offset="'), F.format_string("%.3f", s["off"].cast("double")), F.lit('" stop-color="'), s["color"], F.lit('"/>'))), "")


def gradient_definition(ident: Column, p0: Column, p1: Column, stops: Column) -> Column:
    two = lambda c: F.format_string("%.2f", F.bround(c.cast("double"), 2))
    ends = [piece for name, c in (("x1", p0["x"]), ("y1", p0["y"]), ("x2", p1["x"]), ("y2", p1["y"])) for piece in (F.lit(f' {name}="'), two(c), F.lit('"'))]
    return F.concat(F.lit('<linearGradient id="'), ident, F.lit('" gradientUnits="userSpaceOnUse"'), *ends, F.lit(">"), stop_elements(stops), F.lit("</linearGradient>"))


def gradient_path(ident: Column, d: Column) -> Column:
    return F.concat(F.lit('<path d="'), d, F.lit('" fill="url(#'), ident, F.lit(')" fill-rule="evenodd"/>'))


def count_paths(svg: Column) -> Column:
    return ((F.length(svg) - F.length(F.replace(svg, F.lit("<path"), F.lit("")))) / 5).cast("int")


def ensure_view_box(svg: Column, width: Column, height: Column) -> Column:
    """Put a viewBox into the first ``<svg`` tag that lacks one."""
    at = F.instr(svg, "<svg")
    tag = F.concat(F.lit('<svg viewBox="0 0 '), width.cast("string"), F.lit(" "), height.cast("string"), F.lit('"'))
    made = F.concat(F.substr(svg, F.lit(1), at - 1), tag, F.substr(svg, at + 4))
    return F.when(F.contains(svg, F.lit(" viewBox=")) | (at == 0), svg).otherwise(made)


def data_url(svg: Column) -> Column:
    """URI-encoded as a browser does it: blanks as %20."""
    out = F.replace(F.url_encode(svg), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.concat(F.lit("data:image/svg+xml;charset=utf-8,"), out)


def size_text(n_bytes: Column) -> Column:
    return F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", n_bytes / 1024.0), F.lit(" KB")))


def base_name(name: Column) -> Column:
    """A file name without its last extension; ``image`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("")), F.lit("image"))


def splice(svg: Column, defs: Column, paths: Column) -> Column:
    """Gradients first, flat paths after: right behind the ``<svg …>`` tag; without a tag nothing changes."""
    end = F.instr(F.substr(svg, F.greatest(F.instr(svg, "<svg"), F.lit(1))), ">") + F.instr(svg, "<svg") - 1
    piece = F.concat(F.lit("<defs>"), defs, F.lit("</defs>"), paths)
    return F.when((F.instr(svg, "<svg") == 0) | (end < F.instr(svg, "<svg")), svg).otherwise(F.concat(F.substr(svg, F.lit(1), end), piece, F.substr(svg, end + 1)))
