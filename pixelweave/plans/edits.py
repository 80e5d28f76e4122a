"""An edit log: each SVG's own edits, with undo and redo, replayed over the layer model.

``edits(svg_id, step, op, layer, value)`` are taken by SVG in the order of their
steps. Operations are those of the layer model (``recolor``, ``show``, ``hide``,
``solo``, ``show_all``, ``remove``, ``merge`` into ``value``, ``up``, ``down``) and
those of its history (``undo``, ``redo``, ``reset``). An edit that changes nothing
is no version; a hundred versions can be undone. Replaying needs an SVG's layers
and the layer of each of its shapes, not the shapes themselves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.shared import materialize
from pixelweave.plans.layers import Model, recount

MOST = 100
HEX = re.compile("#[0-9a-f]{6}")
#: Shapes that are Python objects at a time while logs are replayed.
AT_ONCE = 20_000
REPLAYED = [("layers", pa.list_(pa.struct([("layer_id", pa.string()), ("color", pa.string()), ("visible", pa.bool_())]))), ("shapes", pa.list_(pa.struct([("of", pa.int32()), ("layer_id", pa.string())])))]


@dataclass(frozen=True)
class Document:
    """Layers ``(id, color, visible)`` in list order, and shapes ``(number, layer)`` in paint order."""

    layers: tuple[tuple[str, str, bool], ...]
    shapes: tuple[tuple[int, str], ...]

    def edited(self, op: str, layer: str | None, value: str | None) -> Document:
        """The document after an edit; itself if that changes nothing."""
        at = next((k for k, own in enumerate(self.layers) if own[0] == layer), None)
        if op == "show_all":
            return self.painted(lambda own: (own[0], own[1], True))
        if op == "solo":
            return self.painted(lambda own: (own[0], own[1], own[0] == layer))
        if at is None:
            return self
        if op == "recolor":
            color = (value or "").strip().lower()
            return self.painted(lambda own: (own[0], color, own[2]) if own[0] == layer and HEX.fullmatch(color) else own)
        if op in ("show", "hide"):
            return self.painted(lambda own: (own[0], own[1], op == "show") if own[0] == layer else own)
        if op == "remove":
            return Document(tuple(own for own in self.layers if own[0] != layer), tuple(s for s in self.shapes if s[1] != layer))
        if op == "merge" and value != layer and any(own[0] == value for own in self.layers):
            return Document(tuple(own for own in self.layers if own[0] != layer), tuple((n, value if of == layer else of) for n, of in self.shapes))
        if op in ("up", "down"):
            return self.moved(at, -1 if op == "up" else 1)
        return self

    def painted(self, paint) -> Document:
        layers = tuple(map(paint, self.layers))
        return self if layers == self.layers else replace(self, layers=layers)

    def moved(self, at: int, step: int) -> Document:
        """A layer swapped with its neighbour; its shapes go before the neighbour's first or behind its last."""
        if not 0 <= at + step < len(self.layers):
            return self
        layers = list(self.layers)
        layers[at], layers[at + step] = layers[at + step], layers[at]
        own, other = self.layers[at][0], self.layers[at + step][0]
        block, rest = [s for s in self.shapes if s[1] == own], [s for s in self.shapes if s[1] != own]
        there = [k for k, s in enumerate(rest) if s[1] == other]
        place = (there[0] if there else 0) if step < 0 else (there[-1] + 1 if there else len(rest))
        return Document(tuple(layers), tuple(rest[:place] + block + rest[place:]))


@dataclass(frozen=True)
class Versions:
    """A document with those that undo and redo lead to."""

    first: Document
    present: Document
    past: tuple[Document, ...] = ()
    future: tuple[Document, ...] = ()

    def after(self, op: str, layer: str | None, value: str | None) -> Versions:
        if op == "undo":
            return replace(self, present=self.past[-1], past=self.past[:-1], future=(self.present, *self.future)) if self.past else self
        if op == "redo":
            return replace(self, present=self.future[0], past=(*self.past, self.present)[-MOST:], future=self.future[1:]) if self.future else self
        if op == "reset":
            return Versions(self.first, self.first)
        made = self.present.edited(op, layer, value)
        return self if made is self.present else Versions(self.first, made, (*self.past, self.present)[-MOST:])

    def replayed(self, edits: Iterable[tuple]) -> Versions:
        out = self
        for op, layer, value in edits:
            out = out.after(op, layer, value)
        return out


def replay(model: Model, edits: DataFrame) -> Model:
    """The model after each SVG's own edits; SVGs without edits stay, edits of unknown SVGs are passed over.

    Edits of equal steps are taken by operation, layer and value.
    """
    listed = model.layers.groupBy("svg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "layer_id", "color", "visible"))).alias("layers"))
    painted = model.shapes.groupBy("svg_id").agg(F.array_sort(F.collect_list(F.struct("seq", "layer_id"))).alias("shapes"))
    asked = edits.groupBy("svg_id").agg(F.array_sort(F.collect_list(F.struct("step", "op", "layer", "value"))).alias("edits"))
    joined = listed.join(painted, "svg_id", "left").join(asked, "svg_id", "left")

    kind = model.shapes.schema["svg_id"].dataType.simpleString()
    schema = f"svg_id {kind}, layers array<struct<layer_id:string,color:string,visible:boolean>>, shapes array<struct<of:int,layer_id:string>>"

    at_once = AT_ONCE

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches stay in columns; only ``at_once`` shapes or so, and one SVG at least, are objects at a time."""
        for batch in batches:
            if not batch.num_rows:
                continue
            shapes = batch.column("shapes")
            share = (np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(shapes), 0), np.int64)) - 1).clip(0) // at_once
            starts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(starts, starts[1:]):
                rows = []
                for row in batch.slice(start, stop - start).to_pylist():
                    first = Document(tuple((x["layer_id"], x["color"], x["visible"]) for x in row["layers"]), tuple((x["seq"], x["layer_id"]) for x in row["shapes"] or []))
                    last = Versions(first, first).replayed((x["op"], x["layer"], x["value"]) for x in row["edits"] or []).present
                    rows.append({"svg_id": row["svg_id"], "layers": [{"layer_id": i, "color": c, "visible": v} for i, c, v in last.layers], "shapes": [{"of": n, "layer_id": i} for n, i in last.shapes]})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("svg_id", batch.schema.field("svg_id").type), *REPLAYED]))

    n = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = materialize(joined.repartition(n, "svg_id").mapInArrow(replayed, schema), "edited")
    order = made.select("svg_id", F.posexplode("shapes").alias("seq", "s")).select("svg_id", "seq", F.col("s.of").alias("of"), F.col("s.layer_id").alias("layer_id"))
    own = model.shapes.select("svg_id", F.col("seq").alias("of"), "d", "transform")
    shapes = order.join(own, ["svg_id", "of"]).select("svg_id", "seq", "d", "transform", "layer_id")
    layers = made.select("svg_id", F.posexplode("layers").alias("pos", "l")).select("svg_id", "pos", "l.layer_id", "l.color", "l.visible", F.lit(0).cast("long").alias("count"))
    return Model(shapes, recount(layers, order))


# --- the same log as a stream ---


def told(v: Versions) -> str:
    return json.dumps([[d.layers, d.shapes] for d in (v.first, v.present, *v.past, *v.future)] + [len(v.past)])


def read(text: str) -> Versions:
    *each, n = json.loads(text)
    first, present, *others = [Document(tuple(map(tuple, layers)), tuple(map(tuple, shapes))) for layers, shapes in each]
    return Versions(first, present, tuple(others[:n]), tuple(others[n:]))


def edit_stream(edits: DataFrame, models: DataFrame) -> DataFrame:
    """``(svg_id, step, layers, n_shapes)`` after each micro-batch that edits an SVG, from a stream of edits.

    ``models(svg_id, layers, shapes)`` are the SVGs at their start, as JSON
    lists of ``[id, color, visible]`` and ``[number, layer]``. A document and
    its versions are kept per SVG as the stream's state.
    """

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["step", "op"], kind="stable")
        opening = rows[rows["op"] == "open"]
        now = read(state.get[0]) if state.exists else None
        for layer, value in zip(opening["layer"], opening["value"]):
            first = Document(tuple(map(tuple, json.loads(layer))), tuple(map(tuple, json.loads(value))))
            now = Versions(first, first) if now is None else now
        if now is None:
            return
        log = rows[rows["op"] != "open"]
        now = now.replayed(zip(log["op"], log["layer"], log["value"]))
        state.update((told(now),))
        yield pd.DataFrame({"svg_id": [key[0]], "step": [int(rows["step"].max())], "layers": [json.dumps(now.present.layers)], "n_shapes": [len(now.present.shapes)]})

    opened = models.select("svg_id", F.lit(-1).alias("step"), F.lit("open").alias("op"), F.col("layers").alias("layer"), F.col("shapes").alias("value"))
    both = edits.select("svg_id", F.col("step").cast("int").alias("step"), "op", "layer", "value").unionByName(opened)
    return both.groupBy("svg_id").applyInPandasWithState(step, "svg_id long, step int, layers string, n_shapes int", "versions string", "append", "NoTimeout")
