"""The editable layer model over two tables.

``shapes(svg_id, seq, d, transform, layer_id)`` in paint order and
``layers(svg_id, pos, layer_id, color, visible, count)`` in list order. An edit
takes both and returns new ones; nothing is changed in place. Edits hold for
every SVG in the tables that has the layer named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions.color import normalize_fill, normalize_hex
from pixelweave.functions.text import shape_markup

HEX_FILL = "#[0-9a-fA-F]{6}"
PAGE = 200


@dataclass(frozen=True)
class Model:
    shapes: DataFrame
    layers: DataFrame


def layers_from_svg(svgs: DataFrame) -> DataFrame:
    """``(svg_id, layer_id, color, path_count)`` of the hex fills of ``svgs(svg_id, svg)``, in first-seen order."""
    fills = svgs.select("svg_id", F.posexplode(F.regexp_extract_all("svg", F.lit(f'fill="({HEX_FILL})"'), F.lit(1))).alias("at", "fill"))
    counts = fills.groupBy("svg_id", F.lower("fill").alias("color")).agg(F.count("*").alias("path_count"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("svg_id").orderBy("first")) - 1
    return counts.select("svg_id", F.concat(F.lit("layer-"), rank.cast("string")).alias("layer_id"), "color", "path_count")


#: What is read of a path, and of the first SVG element.
PATH_ATTRIBUTES, SIZE_ATTRIBUTES = ("d", "transform", "fill"), ("width", "height", "viewBox")


def told(svg: bytes | None) -> tuple[list, list[list]] | None:
    """The size attributes of the first SVG element of a text, and the attributes of the paths anywhere below it; null for what is no XML.

    Elements may have any prefix. What is missing is null.
    """
    depth, root, size, each = 0, None, [None] * len(SIZE_ATTRIBUTES), []

    def start(name: str, attributes: dict) -> None:
        nonlocal depth, root, size
        depth += 1
        local = name.partition(":")[2] or name
        if root is None and local == "svg":
            root, size = depth, [attributes.get(a) for a in SIZE_ATTRIBUTES]
        elif root and local == "path":
            each.append([attributes.get(a) for a in PATH_ATTRIBUTES])

    def end(name: str) -> None:
        nonlocal depth, root
        if depth == root:
            root = 0
        depth -= 1

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(svg or b"", True)
    except expat.ExpatError:
        return None
    return size, each


def read_svgs(svgs: DataFrame) -> DataFrame:
    """``(svg_id, width, height, paths)`` of ``svgs(svg_id, svg)``: size and paths, with all their attributes.

    Sizes are told by the attributes, else by the viewBox, else 0. A text that
    is not XML has no size and no paths. Each text is read once, by a parser
    without a document tree.
    """
    kind = svgs.schema["svg_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [told(x) for x in batch.column("svg").to_pylist()]
            sizes = [[x and x[0][k] for x in found] for k in range(len(SIZE_ATTRIBUTES))]
            each = [p for x in found if x for p in x[1]]
            ends = np.cumsum([0, *[len(x[1]) if x else 0 for x in found]])
            starts = pa.array(ends, pa.int32(), mask=np.array([*[x is None for x in found], False]))
            paths = pa.StructArray.from_arrays([pa.array([p[k] for p in each], pa.string()) for k in range(len(PATH_ATTRIBUTES))], PATH_ATTRIBUTES)
            yield pa.RecordBatch.from_arrays([batch.column("svg_id"), *[pa.array(s, pa.string()) for s in sizes], pa.ListArray.from_arrays(starts, paths)], ["svg_id", *SIZE_ATTRIBUTES, "paths"])

    read = svgs.select("svg_id", F.col("svg").cast("binary").alias("svg")).mapInArrow(rows, f"svg_id {kind}, {', '.join(f'{a} string' for a in SIZE_ATTRIBUTES)}, paths array<struct<{','.join(f'{a}:string' for a in PATH_ATTRIBUTES)}>>")
    number = lambda text, k: F.nullif(F.regexp_extract(text, k, 1), F.lit("")).cast("double")
    box = r"^\s*[-+.0-9eE]+[\s,]+[-+.0-9eE]+[\s,]+"
    places = {"width": box + r"([.0-9]+)", "height": box + r"[.0-9]+[\s,]+([.0-9]+)"}
    positive = lambda v: F.when(v > 0, v)
    return read.select("svg_id", *[F.coalesce(positive(number(F.col(n), r"^\s*([0-9]*\.?[0-9]+)")), number(F.col("viewBox"), places[n]), F.lit(0.0)).alias(n) for n in ("width", "height")], "paths")


def svg_size(svgs: DataFrame) -> DataFrame:
    """``(svg_id, width, height)`` from the attributes, else from the viewBox, else 0; 0 for what is no XML."""
    return read_svgs(svgs).drop("paths")


def paths_read(read: DataFrame) -> DataFrame:
    """``(svg_id, at, d, transform, color)`` of the paths of :func:`read_svgs` with a hex fill and a non-empty ``d``, and their place."""
    each = read.select("svg_id", F.posexplode("paths").alias("at", "p"))
    return each.select("svg_id", "at", F.col("p.d").alias("d"), F.coalesce("p.transform", F.lit("")).alias("transform"), normalize_fill(F.col("p.fill")).alias("color")).filter("color is not null and d <> ''")


def recount(layers: DataFrame, shapes: DataFrame) -> DataFrame:
    counts = shapes.groupBy("svg_id", "layer_id").agg(F.count("*").alias("n"))
    return layers.drop("count").join(counts, ["svg_id", "layer_id"], "left").select("svg_id", "pos", "layer_id", "color", "visible", F.coalesce("n", F.lit(0)).alias("count"))


def parse_layers(svgs: DataFrame) -> Model:
    """Paths with a hex fill and a non-empty ``d``, at any depth of any SVG; others are dropped. Layers by first-seen colour.

    Attributes may stand in any order and in either quotes, and their entities
    are read; comments and character data hold no paths. A text that is not
    XML, or has no SVG element, has no shapes.
    """
    return layers_read(read_svgs(svgs).drop("width", "height"))


def layers_read(read: DataFrame) -> Model:
    """:func:`parse_layers` of what :func:`read_svgs` gives."""
    found = paths_read(read)
    first = found.withColumn("first", F.min("at").over(Window.partitionBy("svg_id", "color")))
    numbered = first.select("svg_id", (F.row_number().over(Window.partitionBy("svg_id").orderBy("at")) - 1).alias("seq"), "d", "transform", (F.dense_rank().over(Window.partitionBy("svg_id").orderBy("first")) - 1).alias("pos"), "color")
    named = numbered.withColumn("layer_id", F.concat(F.lit("layer-"), F.col("pos").cast("string")))
    layers = named.groupBy("svg_id", "pos", "layer_id", "color").agg(F.count("*").alias("count")).select("svg_id", "pos", "layer_id", "color", F.lit(True).alias("visible"), "count")
    return Model(named.select("svg_id", "seq", "d", "transform", "layer_id"), layers)


def serialize_layers(model: Model, sizes: DataFrame) -> DataFrame:
    """``(svg_id, svg)``: the shapes of visible layers in paint order, with a viewBox."""
    seen = model.shapes.join(model.layers.filter("visible").select("svg_id", "layer_id", "color"), ["svg_id", "layer_id"])
    body = seen.groupBy("svg_id").agg(F.array_sort(F.collect_list(F.struct("seq", shape_markup(F.col("d"), F.col("transform"), F.col("color")).alias("m")))).alias("parts"))
    joined = sizes.join(body, "svg_id", "left")
    text = F.coalesce(F.array_join(F.transform("parts", lambda p: p["m"]), ""), F.lit(""))
    w, h = F.format_string("%.0f", F.col("width").cast("double")), F.format_string("%.0f", F.col("height").cast("double"))
    return joined.select("svg_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">'), text, F.lit("</svg>")).alias("svg"))


def recolor(model: Model, layer_id: str, color: str) -> Model:
    """Set a layer's colour; an invalid one changes nothing. Two layers may share a colour."""
    new = normalize_hex(F.lit(color))
    return Model(model.shapes, model.layers.withColumn("color", F.when((F.col("layer_id") == layer_id) & new.isNotNull(), new).otherwise(F.col("color"))))


def set_visible(model: Model, layer_id: str, visible: bool) -> Model:
    return Model(model.shapes, model.layers.withColumn("visible", F.when(F.col("layer_id") == layer_id, F.lit(visible)).otherwise(F.col("visible"))))


def solo(model: Model, layer_id: str) -> Model:
    return Model(model.shapes, model.layers.withColumn("visible", F.col("layer_id") == layer_id))


def show_all(model: Model) -> Model:
    return Model(model.shapes, model.layers.withColumn("visible", F.lit(True)))


def remove(model: Model, layer_id: str) -> Model:
    shapes = model.shapes.filter(F.col("layer_id") != layer_id)
    return Model(shapes, recount(model.layers.filter(F.col("layer_id") != layer_id), shapes))


def merge(model: Model, source: str, target: str) -> Model:
    """Give the source's shapes to the target and drop the source; paint order stays.

    Nothing changes if both are the same or an SVG lacks the target.
    """
    if source == target:
        return model
    has = model.layers.filter(F.col("layer_id") == target).select("svg_id", F.lit(True).alias("has"))
    moved = model.shapes.join(has, "svg_id", "left").withColumn("layer_id", F.when(F.col("has") & (F.col("layer_id") == source), target).otherwise(F.col("layer_id"))).drop("has")
    left = model.layers.join(has, "svg_id", "left").filter(~(F.coalesce("has", F.lit(False)) & (F.col("layer_id") == source))).drop("has")
    return Model(moved, recount(left, moved))


def reorder(model: Model, layer_id: str, up: bool) -> Model:
    """Swap a layer with its neighbour in the list and move its shapes as one block.

    Neighbours are next to each other in the list's order, whatever gaps
    earlier edits left in ``pos``. Upwards (towards the list's start) the block
    goes before the neighbour's first shape, downwards behind its last; beside
    a layer without shapes it goes to the start or end of all shapes. At the
    list's ends nothing changes.
    """
    step = -1 if up else 1
    by_pos = Window.partitionBy("svg_id").orderBy("pos")
    beside = F.lag if up else F.lead
    listed = model.layers.select("svg_id", "layer_id", F.col("pos").alias("own_pos"), beside("pos").over(by_pos).alias("other_pos"), beside("layer_id").over(by_pos).alias("other"))
    swap = listed.filter((F.col("layer_id") == layer_id) & F.col("other").isNotNull()).drop("layer_id")
    layers = model.layers.join(swap, "svg_id", "left").withColumn("pos", F.when(F.col("layer_id") == layer_id, F.coalesce("other_pos", "pos")).when(F.col("layer_id") == F.col("other"), F.col("own_pos")).otherwise(F.col("pos"))).select(*model.layers.columns)
    place = F.when(F.col("layer_id") == F.col("other"), F.col("seq"))
    at = (F.min if up else F.max)
    edge = model.shapes.join(swap.select("svg_id", "other"), "svg_id").groupBy("svg_id").agg(F.coalesce(at(place), at("seq")).alias("edge"))
    joined = model.shapes.join(edge, "svg_id", "left")
    mine = (F.col("layer_id") == layer_id) & F.col("edge").isNotNull()
    key = F.when(mine, F.struct(F.col("edge").alias("k"), F.lit(step).alias("o"), F.col("seq").alias("s"))).otherwise(F.struct(F.col("seq").alias("k"), F.lit(0).alias("o"), F.col("seq").alias("s")))
    shapes = joined.withColumn("seq", F.row_number().over(Window.partitionBy("svg_id").orderBy(key)) - 1).select(*model.shapes.columns)
    return Model(shapes, layers)


def preview(model: Model, hidden: list[str] = (), only: str | None = None) -> Model:
    """What a preview shows: layers whose colour is not hidden, or those of one colour only."""
    color = F.col("color")
    shown = color == only if only is not None else ~color.isin([*hidden]) if hidden else F.lit(True)
    return Model(model.shapes, model.layers.withColumn("visible", F.col("visible") & shown))


def listing(layers: DataFrame, text: str = "", by_count: bool = True, limit: int = PAGE) -> DataFrame:
    """The list's first rows per SVG for a hex search, with ``matched`` and ``hidden`` counts."""
    found = layers.filter(F.contains("color", F.lit(text.strip().lower())))
    order = [F.desc("count"), "pos"] if by_count else ["pos"]
    ranked = found.withColumns({"rank": F.row_number().over(Window.partitionBy("svg_id").orderBy(*order)), "matched": F.count("*").over(Window.partitionBy("svg_id"))})
    return ranked.filter(F.col("rank") <= limit).withColumn("hidden", F.greatest(F.col("matched") - limit, F.lit(0)))


@dataclass
class History:
    """Undo and redo over model versions; the versions are lineage, not copies."""

    present: Model
    past: list[Model] = field(default_factory=list)
    future: list[Model] = field(default_factory=list)
    most: int = 100

    def set(self, model: Model) -> None:
        if model is not self.present:
            self.past = [*self.past, self.present][-self.most :]
            self.present, self.future = model, []

    def undo(self) -> None:
        if self.past:
            self.future.insert(0, self.present)
            self.present = self.past.pop()

    def redo(self) -> None:
        if self.future:
            self.past.append(self.present)
            self.present = self.future.pop(0)

    def reset(self, model: Model) -> None:
        self.past, self.present, self.future = [], model, []
