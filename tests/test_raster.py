"""Properties of the raster operators on synthetic fixtures."""

import random

import numpy as np
import pytest

from pixelweave.functions import color, params
from pixelweave.functions import text as svg_text
from pixelweave.operators import classify, components, contour, gradient, palette, stencil
from pixelweave.plans import layers, trace
from pixelweave.sources import rasters
from pyspark.sql import functions as F

PIXELS = "image_id long, i long, x int, y int, r int, g int, b int, a int"


def image(width, height, paint, image_id=0):
    out = []
    for y in range(height):
        for x in range(width):
            c = paint(x, y)
            out.append((image_id, y * width + x, x, y, *c[:3], c[3] if len(c) > 3 else 255))
    return out


def three_band(image_id=0):
    return image(32, 32, lambda x, y: [(220, 30, 30), (30, 200, 60), (40, 60, 210)][x * 3 // 32], image_id)


def fine_feature(image_id=0):
    marks = [(220, 30, 30), (30, 200, 60), (40, 60, 210), (230, 200, 20), (150, 30, 200)]
    squares = {(x, y): marks[k % 5] for k, (x, y) in enumerate((x, y) for y in (4, 14, 24, 34) for x in (4, 14, 24, 34))}

    def paint(x, y):
        for (sx, sy), c in squares.items():
            if sx <= x < sx + 4 and sy <= y < sy + 4:
                return c
        return (200, 200, 200)

    return image(48, 48, paint, image_id)


def linear_ramp(image_id=0):
    return image(64, 16, lambda x, y: (x * 255 // 63,) * 3, image_id)


def gradient_disc(image_id=0):
    def paint(x, y):
        if (x - 48) ** 2 + (y - 48) ** 2 > 36 * 36:
            return (235, 235, 235)
        v = int(70 + 140 * min(max((x - 12) / 72, 0), 1))
        return (v, v * 3 // 4, 200)

    return image(96, 96, paint, image_id)


def pixels(spark, *images):
    return spark.createDataFrame([p for rows in images for p in rows], PIXELS)


def test_oklab_of_white_is_neutral_and_bytes_survive(spark):
    rows = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    l, a, b = color.oklab(F.col("r"), F.col("g"), F.col("b"))
    made = df.select("*", l.alias("l"), a.alias("oa"), b.alias("ob"))
    back = [c.alias(n) for c, n in zip(color.oklab_to_bytes(F.col("l"), F.col("oa"), F.col("ob")), ("pr", "pg", "pb"))]
    for x in made.select("*", *back).collect():
        assert (x["r"], x["g"], x["b"]) == (x["pr"], x["pg"], x["pb"])
        if x["r"] == x["g"] == x["b"]:
            assert abs(x["oa"]) < 1e-4 and abs(x["ob"]) < 1e-4
        if (x["r"], x["g"], x["b"]) == (255, 255, 255):
            assert abs(x["l"] - 1) < 1e-4


def test_classes_of_the_fixtures(spark):
    rows = {x["image_id"]: x for x in classify.classify(pixels(spark, three_band(1), fine_feature(2), linear_ramp(3), gradient_disc(4), image(2, 2, lambda x, y: (0, 0, 0, 0), 5))).collect()}
    assert (rows[1]["class"], rows[1]["effective"], round(rows[1]["edge_density"], 4)) == ("Logo", 3, 0.1333)
    assert (rows[2]["class"], rows[2]["effective"], round(rows[2]["edge_density"], 4)) == ("Logo", 3, 0.2023)
    assert (rows[3]["class"], rows[3]["effective"], rows[3]["edge_density"]) == ("Illustration", 15, 0)
    assert (rows[4]["class"], rows[4]["effective"], round(rows[4]["edge_density"], 4)) == ("Illustration", 11, 0.0656)
    assert (rows[5]["effective"], rows[5]["edge_density"]) == (1, 0)


def sizes(spark, rows):
    out = components.segment(pixels(spark, rows)).groupBy("comp").count().collect()
    return sorted((x["count"] for x in out), reverse=True)


def test_segments_of_the_fixtures(spark):
    assert sizes(spark, image(8, 8, lambda x, y: (120, 120, 120))) == [64]
    assert sizes(spark, image(96, 8, lambda x, y: (80 + x * 120 // 95,) * 3)) == [768]
    assert sizes(spark, image(16, 8, lambda x, y: (20 if x < 8 else 220,) * 3)) == [64, 64]
    assert sizes(spark, image(8, 8, lambda x, y: (100, 100, 100, 0 if y == 0 else 255))) == [56]
    assert sizes(spark, three_band()) == [352, 352, 320]
    assert sizes(spark, gradient_disc()) == [5163, 4053]


def test_components_cross_strips_and_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "STRIP", 3)
    r = random.Random(7)
    grid = {(x, y): r.randrange(3) for y in range(20) for x in range(15)}
    rows = [(0, y * 15 + x, x, y, v) for (x, y), v in grid.items()]
    want = {}
    for (x, y) in sorted(grid, key=lambda c: (c[1], c[0])):
        if (x, y) in want:
            continue
        stack, want[x, y] = [(x, y)], y * 15 + x
        while stack:
            px, py = stack.pop()
            for q in ((px - 1, py), (px + 1, py), (px, py - 1), (px, py + 1)):
                if q in grid and q not in want and grid[q] == grid[px, py]:
                    want[q] = want[x, y]
                    stack.append(q)
    for parts in (1, 5):
        cells = spark.createDataFrame(rows, "image_id long, i long, x int, y int, pid int").repartition(parts)
        got = {(x["x"], x["y"]): x["comp"] for x in components.components(cells, ["pid"]).collect()}
        assert got == want
    # the same raster, despeckled in order
    out, comps = dict(grid), {}
    for c, root in want.items():
        comps.setdefault(root, []).append(c)
    for root in sorted(comps):
        if len(comps[root]) <= 4:
            tally = {}
            for px, py in comps[root]:
                for q in ((px - 1, py), (px + 1, py), (px, py - 1), (px, py + 1)):
                    if q in grid and want[q] != root:
                        tally[out[q]] = tally.get(out[q], 0) + 1
            best = min(tally, key=lambda c: (-tally[c], c))
            for c in comps[root]:
                out[c] = best
    got = {(x["x"], x["y"]): x["pid"] for x in components.despeckle(spark.createDataFrame(rows, "image_id long, i long, x int, y int, pid int"), 4).collect()}
    assert got == out


def test_palette_of_three_bands_and_k(spark):
    lab = color.with_oklab(pixels(spark, three_band()))
    for k, n in ((3, 3), (2, 2), (0, 1)):
        got = palette.quantize(lab.select("image_id", "i", "l", "oa", "ob"), spark.createDataFrame([(0, k)], "image_id long, k int"))
        hexes = [r["h"] for r in got.orderBy("pid").select(color.hex_color(*color.oklab_to_bytes(F.col("l"), F.col("oa"), F.col("ob"))).alias("h")).collect()]
        assert len(hexes) == n
        if k == 3:
            assert sorted(hexes) == ["#1ec83c", "#283cd2", "#dc1e1e"]


def test_order_by_area_counts_empty_entries(spark):
    assigned = spark.createDataFrame([(0, i, p) for i, p in enumerate([0, 1, 1, 1, 1, 2, 0, 0])], "image_id long, i long, pid int")
    colors = palette.locked(spark, [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3)])
    assert [(r["pid"], r["area"]) for r in palette.order_by_area(assigned, colors).orderBy("z").collect()] == [(1, 4), (0, 3), (2, 1), (3, 0)]


def test_bilateral_keeps_flat_and_small_images(spark):
    flat, small = image(6, 5, lambda x, y: (80, 140, 200, 0 if x == 0 else 255)), image(2, 2, lambda x, y: (x * 90, y * 70, 9), 1)
    got = stencil.bilateral(pixels(spark, flat, small), 0.1)
    assert sorted(map(tuple, got.select("image_id", "i", "x", "y", "r", "g", "b", "a").collect())) == sorted(flat + small)


def test_gradients_of_the_fixtures(spark):
    region = components.segment(pixels(spark, linear_ramp(1), gradient_disc(2), three_band(3)))
    fits = {x["image_id"]: x for x in gradient.detect(region).collect()}
    assert sorted(fits) == [1, 2]
    ramp, disc = fits[1], fits[2]
    assert abs(ramp["p0"]["y"] - 7.5) < 0.01 and abs(ramp["p1"]["x"] - 63) < 0.01 and ramp["stops"][0]["off"] == 0 and ramp["stops"][-1]["off"] == 1
    assert abs(disc["p0"]["x"] - 12) < 0.2 and abs(disc["p1"]["x"] - 84) < 0.2 and 2 <= len(disc["stops"]) <= 5
    assert ramp["stops"][-1]["color"] == "#ffffff"


def test_rings_of_masks():
    cells = lambda *rects: {(x, y) for x0, y0, x1, y1 in rects for x in range(x0, x1) for y in range(y0, y1)}
    assert contour.mask_rings(set()) == []
    assert [len(p) for _, p in contour.mask_rings({(1, 1)})] == [4]
    rect = contour.mask_rings(cells((4, 5, 14, 11)))
    assert len(rect) == 1 and len(rect[0][1]) == 4 and contour.signed_area(rect[0][1]) == -60
    ring = contour.mask_rings(cells((4, 4, 16, 16)) - cells((8, 8, 12, 12)))
    assert [(h, contour.signed_area(p)) for h, p in ring] == [(False, -144), (True, 16)]
    pinched = contour.mask_rings({(0, 0), (1, 1)})
    assert [contour.signed_area(p) for _, p in pinched] == [-1, -1]
    hole = {(x, y) for y, row in enumerate(["..####.", ".#.###.", ".#####."]) for x, c in enumerate(row) if c == "#"}
    found = contour.link_rings(hole)
    assert sum(map(contour.signed_area, found)) == len(hole)  # areas of outlines less holes
    r = random.Random(3)
    for _ in range(30):
        some = {(r.randrange(9), r.randrange(9)) for _ in range(40)}
        assert sum(map(contour.signed_area, contour.link_rings(some))) == len(some)


def test_simplification_keeps_within_epsilon():
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    ring = np.stack([50 * np.cos(t), 30 * np.sin(t)], axis=1)
    out = contour.simplify_ring(ring, 0.75)
    assert 3 <= len(out) < 60
    assert len(contour.simplify_ring(ring[:3], 0.75)) == 3
    assert contour.line_distance(np.array([[3.0, 4.0]]), np.zeros(2), np.zeros(2))[0] == 5


def test_dilate_and_corners(spark):
    mask = spark.createDataFrame([(0, x, y) for x in (4, 5) for y in (4, 5)], "image_id long, x int, y int")
    assert stencil.dilate(mask, 10, 10).count() == 12
    assert stencil.dilate(mask, 10, 10, 0).count() == 4
    codes = {(r["x"], r["y"]): r["code"] for r in stencil.corner_codes(mask).collect()}
    assert codes[5, 5] == 15 and codes[4, 4] == 8 and codes[6, 6] == 1 and codes[6, 4] == 4


def test_raster_source_checks_and_round_trip(spark):
    rows = [(1, 2, 1, bytes([1, 2, 3, 255, 9, 8, 7, 0])), (2, 0, 5, b""), (3, 2, 2, b"123"), (4, 1, 1, None)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, data binary")
    assert {r["image_id"]: r["error"] for r in rasters.validated(df).collect()} == {1: None, 2: "empty image", 3: "buffer does not match dimensions", 4: "buffer does not match dimensions"}
    px = rasters.explode_rasters(df)
    assert sorted(tuple(r) for r in px.collect()) == [(1, 0, 0, 0, 1, 2, 3, 255), (1, 1, 1, 0, 9, 8, 7, 0)]
    back = rasters.collect_rasters(px).first()
    assert bytes(back["data"]) == rows[0][3] and (back["width"], back["height"]) == (2, 1)
    halved = rasters.downsample(pixels(spark, image(8, 4, lambda x, y: (x * 10, 0, 0))), 4)
    assert sorted((r["x"], r["y"], r["r"]) for r in halved.collect()) == [(x, y, 20 * x + 5) for x in range(4) for y in range(2)]


def test_encoded_images(spark, tmp_path):
    import struct
    import zlib as z

    def png(path, rgba, w, h):
        raw = b"".join(b"\0" + rgba[y * w * 4 : (y + 1) * w * 4] for y in range(h))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", z.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", z.compress(raw)) + chunk(b"IEND", b""))

    data = bytes(range(24)) + bytes([200, 100, 50, 255] * 0)
    png(tmp_path / "pic.v1.png", data, 3, 2)
    assert tuple(rasters.image_sizes(spark, str(tmp_path)).first()) == ("pic.v1.png", 3, 2)
    got = rasters.read_images(spark, str(tmp_path)).select("*", svg_text.base_name(F.col("name")).alias("base")).first()
    assert (bytes(got["data"]), got["width"], got["height"], got["base"]) == (data, 3, 2, "pic.v1")


def test_stream_traces_every_image_once(spark, tmp_path):
    from pixelweave.streaming import ingest

    rows = rasters.collect_rasters(pixels(spark, three_band(1), three_band(2)))
    rows.filter("image_id = 1").write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.trace_stream(ingest.raster_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        rows.filter("image_id = 2").write.mode("append").parquet(f"{tmp_path}/in")
    got = spark.read.parquet(f"{tmp_path}/out").select("image_id", "stats.path_count").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, 3)]


def test_options():
    assert params.Options.from_json("{}") == params.DEFAULT
    assert params.Options.from_json('{"k": 4, "lock_palette": [[1,2,3]], "other": 1}').lock_palette == ((1, 2, 3),)
    for bad in ('{"class_override": "Cat"}', '{"k": -1}', "[", '{"lock_palette": [[1, 2]]}', '{"photo_mode": "x"}'):
        with pytest.raises(ValueError):
            params.Options.from_json(bad)
    ui = params.Options.from_ui({"class": "logo", "colors": "16"})
    assert ui.class_override == "Logo" and ui.k == 16 and ui.detail == 0.6
    assert params.Options.from_ui({}).k is None


def traced(spark, rows, **how):
    return trace.trace(pixels(spark, rows), params.Options(**how)).first()


def test_trace_of_three_bands(spark):
    got = traced(spark, three_band())
    assert got["stats"]["path_count"] == 3 and got["stats"]["classified_as"] == "Logo" and "Gradient" not in got["svg"]
    want = [(220, 30, 30), (30, 200, 60), (40, 60, 210)]
    near = lambda h, c: sum((int(h[1 + 2 * k : 3 + 2 * k], 16) - c[k]) ** 2 for k in range(3)) <= 24 * 24
    assert all(any(near(h, c) for h in got["stats"]["palette"]) for c in want)
    assert got["stats"]["est_bytes"] == len(got["svg"].encode()) and ' viewBox="0 0 32 32"' in got["svg"]
    assert got == traced(spark, three_band())
    assert len(traced(spark, three_band(), k=2)["stats"]["palette"]) == 2


def test_more_detail_keeps_more_paths(spark):
    low, high = traced(spark, fine_feature(), class_override="Illustration", detail=0.0), traced(spark, fine_feature(), class_override="Illustration", detail=1.0)
    assert high["stats"]["path_count"] > low["stats"]["path_count"]


def test_gradient_trace(spark):
    disc = traced(spark, gradient_disc(), gradients=True)
    svg = disc["svg"]
    assert "<rect" not in svg and svg.index("<svg") == 0 and svg.index("<svg") < svg.index("<linearGradient") < svg.index("url(#g0)") < svg.index('fill="#') < svg.index("</svg>")
    assert disc["stats"]["path_count"] == disc["stats"]["path_count_distinct"] + 1
    assert "linearGradient" not in traced(spark, gradient_disc())["svg"]
    assert "linearGradient" not in traced(spark, three_band(), gradients=True)["svg"]


def test_black_white_locked_and_blank(spark):
    bw = traced(spark, three_band(), bw_mode=True)
    assert bw["stats"]["palette"] == ["#000000"] and bw["stats"]["classified_as"] == "Logo"
    locked = traced(spark, three_band(), lock_palette=((255, 0, 0), (0, 0, 255)))
    assert locked["stats"]["palette"] == ["#ff0000", "#0000ff"]
    free = traced(spark, three_band(), lock_palette=())
    assert free["stats"]["path_count"] == 3 and free["stats"]["palette"] == []
    blank = traced(spark, image(4, 4, lambda x, y: (9, 9, 9, 0)))
    assert blank["stats"]["path_count"] == 0


def test_history_and_edits(spark):
    svgs = spark.createDataFrame([(0, '<svg width="5" height="6"><path d="M0" fill="#FF0000"/><path d="" fill="#00ff00"/><path d="M1" fill="url(#g)"/><path d="M2" fill="#00ff00"/><path d="M3" fill="#ff0000"/></svg>')], "svg_id long, svg string")
    model = layers.parse_layers(svgs)
    assert [(r["color"], r["count"]) for r in model.layers.orderBy("pos").collect()] == [("#ff0000", 2), ("#00ff00", 1)]
    h = layers.History(model)
    h.set(layers.remove(model, "layer-0"))
    assert h.present.shapes.count() == 1
    h.undo()
    assert h.present is model
    h.redo()
    assert h.present.layers.count() == 1
    h.set(h.present)
    assert len(h.past) == 1
    down = layers.reorder(model, "layer-0", up=False)
    assert [r["d"] for r in down.shapes.orderBy("seq").collect()] == ["M2", "M0", "M3"]
    assert layers.merge(model, "layer-0", "nope").shapes.filter("layer_id = 'layer-0'").count() == 2
    assert [r["visible"] for r in layers.preview(model, hidden=["#ff0000"]).layers.orderBy("pos").collect()] == [False, True]
    assert [r["visible"] for r in layers.preview(model, only="#ff0000").layers.orderBy("pos").collect()] == [True, False]
    assert all(r["visible"] for r in layers.preview(model).layers.collect())
    text = layers.serialize_layers(layers.solo(model, "layer-1"), layers.svg_size(svgs)).first()["svg"]
    assert text.count("<path") == 1 and 'viewBox="0 0 5 6"' in text


def test_edits_in_sequence(spark):
    paths = "".join(f'<path d="M{k}" fill="#0000{k:02x}"/>' for k in range(5))
    model = layers.parse_layers(spark.createDataFrame([(0, f'<svg width="5" height="6">{paths}</svg>')], "svg_id long, svg string"))
    order = lambda m: ([r["d"] for r in m.shapes.orderBy("seq").collect()], [r["layer_id"] for r in m.layers.orderBy("pos").collect()])
    removed = layers.remove(model, "layer-2")
    assert order(layers.reorder(removed, "layer-3", up=True)) == (["M0", "M3", "M1", "M4"], ["layer-0", "layer-3", "layer-1", "layer-4"])
    merged = layers.merge(model, "layer-1", "layer-0")
    assert order(layers.reorder(merged, "layer-2", up=True)) == (["M2", "M0", "M1", "M3", "M4"], ["layer-2", "layer-0", "layer-3", "layer-4"])
    hollow = layers.Model(model.shapes.filter("layer_id <> 'layer-1'"), model.layers)
    assert order(layers.reorder(hollow, "layer-2", up=True))[0] == ["M2", "M0", "M3", "M4"]
    assert order(layers.reorder(hollow, "layer-0", up=False)) == (["M2", "M3", "M4", "M0"], ["layer-1", "layer-0", "layer-2", "layer-3", "layer-4"])
    assert order(layers.reorder(model, "layer-0", up=True)) == order(model) and order(layers.reorder(model, "layer-4", up=False)) == order(model)


def test_images_beyond_the_longest_edge_are_brought_down(spark):
    wide = pixels(spark, image(64, 8, lambda x, y: (220, 30, 30) if x < 32 else (30, 40, 200)))
    small = pixels(spark, three_band()).withColumn("image_id", F.lit(1).cast("long"))
    both = trace.bounded(wide.unionByName(small), 32)
    assert {r["image_id"]: (r["w"], r["h"]) for r in stencil.image_sizes(both).collect()} == {0: (32, 4), 1: (32, 32)}
    assert trace.bounded(small, 32) is small


def brute_islands(grid, most):
    """Small components in scan order, each painted in the colour that is most frequent around it by then."""
    h, w = len(grid), len(grid[0])
    comp = [[-1] * w for _ in range(h)]
    members = []
    for y in range(h):
        for x in range(w):
            if comp[y][x] < 0:
                stack, own = [(x, y)], []
                comp[y][x] = len(members)
                while stack:
                    a, b = stack.pop()
                    own.append((a, b))
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < w and 0 <= d < h and comp[d][c] < 0 and grid[d][c] == grid[y][x]:
                            comp[d][c] = len(members)
                            stack.append((c, d))
                members.append(own)
    out = [list(row) for row in grid]
    for k, own in enumerate(members):
        if len(own) <= most:
            tally = {}
            for a, b in own:
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < w and 0 <= d < h and comp[d][c] != k:
                        tally[out[d][c]] = tally.get(out[d][c], 0) + 1
            if tally:
                paint = min(tally, key=lambda c: (-tally[c], c))
                for a, b in own:
                    out[b][a] = paint
    return out


def test_islands_are_resolved_in_scan_order(spark):
    rng = random.Random(6)
    grids = [[[rng.randrange(4) for _ in range(9)] for _ in range(7)] for _ in range(30)] + [[[rng.randrange(3) for _ in range(40)] for _ in range(30)]]
    rows = [(k, y * len(g[0]) + x, x, y, g[y][x]) for k, g in enumerate(grids) for y in range(len(g)) for x in range(len(g[0]))]
    cells = spark.createDataFrame(rows, "image_id long, i long, x int, y int, pid int")
    got = {(r["image_id"], r["x"], r["y"]): r["pid"] for r in components.despeckle(cells, 3).collect()}
    for k, g in enumerate(grids):
        want = brute_islands(g, 3)
        assert all(got[k, x, y] == want[y][x] for y in range(len(g)) for x in range(len(g[0])))


def test_groups_stream_through_batches(spark):
    from pixelweave.functions.shared import by_group

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("id % 3 a", "id div 100 b", "id")
        got = by_group(df, ["a", "b"], ["id"], lambda p: p.groupby(["a", "b"], as_index=False).agg(n=("id", "size"), first=("id", "first"), last=("id", "last")), "a long, b long, n long, first long, last long").collect()
        want = df.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_results_are_written(spark, tmp_path):
    rows = trace.trace(pixels(spark, three_band()))
    rasters.write_results(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first()["stats"]["classified_as"] == "Logo"
    rasters.write_svgs(rows.select(F.lit("a.b.png").alias("name"), "svg"), f"{tmp_path}/svg")
    assert spark.read.text(f"{tmp_path}/svg/name=a.b.svg").first()["value"].startswith("<svg")
    assert trace.web_stats(rows, stencil.image_sizes(pixels(spark, three_band()))).first()["width"] == 32


def test_sweep_runs_every_valid_variation(spark):
    specs = [("two", {"k": 2}), ("bad", {"detail": 0.5, "photo_mode": "x"}), ("bw", {"bw_mode": True})]
    rows = trace.sweep(pixels(spark, three_band()), variations=specs).collect()
    assert sorted(r["name"] for r in rows if r["error"] is None) == ["bw", "two"]
    assert [(r["variant"], r["name"], r["svg"]) for r in rows if r["error"]] == [(1, "bad", None)]
    with pytest.raises(ValueError):
        trace.sweep(pixels(spark, three_band()), variations=specs[1:2])
