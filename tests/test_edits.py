"""Edit logs replayed at once, as a stream, and step by step over the layer model."""

import json
import random

from pixelweave.plans import edits, layers

LOG = "svg_id long, step int, op string, layer string, value string"


def svg_rows():
    colors = ["#ff0000", "#00ff00", "#0000ff", "#ffff00", "#00ffff"]
    r = random.Random(3)
    return [(k, '<svg width="9" height="9">' + "".join(f'<path d="M{j}" fill="{r.choice(colors[: k + 2])}"/>' for j in range(7)) + "</svg>") for k in range(4)]


def logs(seed, n=14):
    r = random.Random(seed)
    ops = ["recolor", "show", "hide", "solo", "show_all", "remove", "merge", "up", "down", "undo", "undo", "redo", "reset"]
    out = []
    for svg in range(4):
        for step in range(n):
            op = r.choice(ops[:-1]) if r.random() < 0.95 else "reset"
            value = f"layer-{r.randrange(5)}" if op == "merge" else r.choice([" #ABCDEF ", "#123456", "red"]) if op == "recolor" else None
            out.append((svg, step, op, f"layer-{r.randrange(5)}", value))
    return out


def step_by_step(model, log):
    """The same log over one SVG's model with the layer model's own edits; a version is kept only if it differs."""
    tables = lambda m: (tuple((r["layer_id"], r["color"], r["visible"]) for r in m.layers.orderBy("pos").collect()), tuple((r["d"], r["layer_id"]) for r in m.shapes.orderBy("seq").collect()))
    calls = {
        "recolor": lambda m, a, b: layers.recolor(m, a, b), "show": lambda m, a, b: layers.set_visible(m, a, True), "hide": lambda m, a, b: layers.set_visible(m, a, False), "solo": lambda m, a, b: layers.solo(m, a), "show_all": lambda m, a, b: layers.show_all(m),
        "remove": lambda m, a, b: layers.remove(m, a), "merge": lambda m, a, b: layers.merge(m, a, b), "up": lambda m, a, b: layers.reorder(m, a, up=True), "down": lambda m, a, b: layers.reorder(m, a, up=False),
    }
    h = layers.History(model)
    for op, a, b in log:
        if op in ("undo", "redo"):
            getattr(h, op)()
        elif op == "reset":
            h.reset(model)
        else:
            made = calls[op](h.present, a, b)
            h.set(h.present if tables(made) == tables(h.present) else made)
    return tables(h.present)


def test_replay_is_step_by_step(spark):
    model = layers.parse_layers(spark.createDataFrame(svg_rows(), "svg_id long, svg string"))
    for table in ("layers", "shapes"):
        getattr(model, table).cache().count()
    log = logs(5, 6)
    got = edits.replay(model, spark.createDataFrame([*log, (99, 0, "undo", None, None)], LOG))
    shapes, listed = got.shapes.collect(), got.layers.collect()
    for svg in range(3):
        one = layers.Model(model.shapes.filter(f"svg_id = {svg}"), model.layers.filter(f"svg_id = {svg}"))
        want = step_by_step(one, [e[2:] for e in log if e[0] == svg])
        assert tuple((r["layer_id"], r["color"], r["visible"]) for r in sorted(listed, key=lambda r: r["pos"]) if r["svg_id"] == svg) == want[0]
        assert tuple((r["d"], r["layer_id"]) for r in sorted(shapes, key=lambda r: r["seq"]) if r["svg_id"] == svg) == want[1]
    assert all(r["count"] == sum(s["svg_id"] == r["svg_id"] and s["layer_id"] == r["layer_id"] for s in shapes) for r in listed)


def test_a_hundred_versions_can_be_undone():
    first = edits.Document((("layer-0", "#000000", True),), ((0, "layer-0"),))
    v = edits.Versions(first, first).replayed([("recolor", "layer-0", f"#0000{k:02x}") for k in range(1, 151)])
    assert len(v.past) == 100 and v.replayed([("undo", None, None)] * 200).present.layers[0][1] == "#000032"
    assert v.replayed([("undo", None, None)] * 3 + [("redo", None, None)] * 2).present.layers[0][1] == "#000095"
    assert v.after("recolor", "layer-0", "no colour") is v and v.after("remove", "layer-9", None) is v and v.after("up", "layer-0", None) is v
    assert edits.read(edits.told(v)) == v


def test_a_stream_of_edits_ends_where_the_replay_does(spark, tmp_path):
    first = edits.Document((("layer-0", "#000000", True), ("layer-1", "#ffffff", True)), ((0, "layer-0"), (1, "layer-1"), (2, "layer-0")))
    model = [(k, json.dumps(first.layers), json.dumps(first.shapes)) for k in range(3)]
    log = [e for e in logs(9, 10) if e[0] < 3]
    half = [e for e in log if e[1] < 5], [e for e in log if e[1] >= 5]
    spark.createDataFrame(model, "svg_id long, layers string, shapes string").write.parquet(f"{tmp_path}/models")
    for part in half:
        spark.createDataFrame(part, LOG).write.mode("append").parquet(f"{tmp_path}/log")
        stream = edits.edit_stream(spark.readStream.schema(LOG).parquet(f"{tmp_path}/log"), spark.readStream.schema("svg_id long, layers string, shapes string").parquet(f"{tmp_path}/models"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r["step"]):
        last[r["svg_id"]] = r
    for k in range(3):
        want = edits.Versions(first, first).replayed(e[2:] for e in log if e[0] == k).present
        assert json.loads(last[k]["layers"]) == [list(x) for x in want.layers] and last[k]["n_shapes"] == len(want.shapes)
