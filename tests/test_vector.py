"""Rings over tiles, paths read and written, SVG drawn again, palettes in batches, sweeps as one job, foreign SVG."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import params, paths
from pixelweave.operators import components, contour, palette
from pixelweave.plans import draw, layers, trace

CELLS = "image_id long, comp long, x int, y int"
PIXELS = "image_id long, i long, x int, y int, r int, g int, b int, a int"


def noise(seed, width=23, height=17, colors=3, image_id=0):
    r = random.Random(seed)
    return [(image_id, y * width + x, x, y, *[(r.randrange(colors) * 90) for _ in range(3)], 255 if r.random() < 0.9 else 0) for y in range(height) for x in range(width)]


def ring_rows(df):
    return sorted((r["image_id"], r["comp"], r["ring_id"], r["is_hole"], tuple((p["x"], p["y"]) for p in r["pts"])) for r in df.collect())


@pytest.mark.parametrize("epsilon", [0.0, 0.75])
def test_rings_do_not_depend_on_tiles_or_partitions(spark, epsilon):
    r = random.Random(4)
    blob = [(0, 0, x, y) for x in range(31) for y in range(29) if r.random() < 0.62]
    spiral = [(1, 5, x, y) for x in range(25) for y in range(25) if max(abs(x - 12), abs(y - 12)) % 2 == 0 and (x, y) != (12 + max(abs(x - 12), abs(y - 12)), 12)]
    rows = blob + spiral + [(1, 9, 0, 0), (1, 9, 1, 1), (2, 1, 7, 7)]
    masks = {}
    for image, comp, x, y in rows:
        masks.setdefault((image, comp), set()).add((x, y))
    want = []
    for (image, comp), cells in masks.items():
        want += [(image, comp, k, hole, tuple(map(tuple, points.tolist()))) for k, (hole, points) in enumerate(contour.mask_rings(cells, epsilon))]
    for tile, parts in ((256, 1), (8, 3), (3, 4), (1, 2)):
        mask = spark.createDataFrame(rows, CELLS).repartition(parts)
        assert ring_rows(contour.trace_rings(mask, ["image_id", "comp"], epsilon, tile)) == sorted(want)


def test_cells_that_meet_at_a_corner(spark):
    rows = [(0, 0, 0, 0), (0, 0, 1, 1)]
    apart = ring_rows(contour.trace_rings(spark.createDataFrame(rows, CELLS), ["image_id", "comp"], 0.0, 1))
    joined = ring_rows(contour.trace_rings(spark.createDataFrame(rows, CELLS), ["image_id", "comp"], 0.0, 1, cross=True))
    assert [len(r[4]) for r in apart] == [4, 4] and [len(r[4]) for r in joined] == [8]
    r = random.Random(8)
    for _ in range(40):
        cells = {(r.randrange(8), r.randrange(8)) for _ in range(30)}
        assert sum(map(contour.signed_area, contour.link_rings(cells, cross=True))) == len(cells)
    assert ring_rows(contour.trace_rings(spark.createDataFrame([], CELLS), ["image_id", "comp"])) == []


def brute_rdp(p, epsilon):
    if len(p) < 3:
        return p
    d = [float(contour.line_distance(q, p[0], p[-1])) for q in p[1:-1]]
    k = int(np.argmax(d)) + 1
    return np.concatenate([brute_rdp(p[: k + 1], epsilon)[:-1], brute_rdp(p[k:], epsilon)]) if d[k - 1] > epsilon else p[[0, -1]]


def test_all_rings_are_simplified_as_each_alone():
    r = np.random.default_rng(2)
    rings = [r.uniform(0, 20, (n, 2)) for n in (1, 2, 3, 4, 5, 9, 40, 200)] + [np.zeros((0, 2)), np.ones((6, 2))]
    for epsilon in (0.0, 1.0, 30.0):
        points, sizes = contour.simplify_all(np.concatenate(rings), np.array([len(x) for x in rings]), epsilon)
        for own, made in zip(rings, np.split(points, np.cumsum(sizes)[:-1])):
            want = own
            if len(own) >= 4:
                a = int(((own - own[0]) ** 2).sum(1).argmax())
                lo, hi = sorted((a, int(((own - own[a]) ** 2).sum(1).argmax())))
                cut = np.concatenate([brute_rdp(own[lo : hi + 1], epsilon), brute_rdp(np.concatenate([own[hi:], own[: lo + 1]]), epsilon)[1:-1]])
                want = cut if len(cut) >= 3 else own
            assert np.array_equal(made, want)


# --- paths ---


def test_paths_are_read():
    assert paths.read_path("M1 2L3 4 5,6Z") == [[(1, 2), (3, 4), (5, 6)]]
    assert paths.read_path("m1 1l2 0 0 2-2 0zl5 5") == [[(1, 1), (3, 1), (3, 3), (1, 3)], [(1, 1), (6, 6)]]
    assert paths.read_path("M0-.5.25.75h1e1v-2H3V4z") == [[(0, -0.5), (0.25, 0.75), (10.25, 0.75), (10.25, -1.25), (3, -1.25), (3, 4)]]
    assert paths.read_path("M1 1S2 2 3 3L5 5") == [[(1, 1), (5, 5)]] and len(paths.read_path("M1 1C2 2 3 3 4 4L5 5")[0]) == 10 and paths.read_path("") == [] and paths.read_path("M 3") == []


def test_short_paths_keep_the_geometry():
    r = random.Random(11)
    for _ in range(400):
        rings = [[(r.choice([0, r.randrange(-3000, 3000), 50 * r.randrange(-9, 9)]), r.choice([0, r.randrange(-200, 200)])) for _ in range(r.randrange(1, 9))] for _ in range(r.randrange(1, 4))]
        d = "".join("M" + "L".join(f"{x / 100:g} {y / 100:g}" for x, y in ring) + "Z" for ring in rings)
        short = paths.short_path(d)
        back = [[(round(x * 100), round(y * 100)) for x, y in ring] for ring in paths.read_path(short)]

        def tidy(ring):
            return tidy(ring[:-1]) if len(ring) > 1 and ring[0] == ring[-1] else ring

        assert [tidy(x) for x in back] == [tidy(x) for x in rings] and len(short) <= len(d)
    assert paths.short_path("M0 0L10 0L10 5L0 5Z") == "M0 0h10v5H0z" and paths.short_path("M0 0C1 1 2 2 3 3Z") == "M0 0C1 1 2 2 3 3Z"
    svg = '<svg id="M0 0L1 0Z"><path id="a" d="M0 0L10 0L10 5Z" fill="#112233"/></svg>'
    assert paths.short_svg(svg) == svg.replace("M0 0L10 0L10 5Z", "M0 0h10v5z")


# --- drawing ---


def test_an_exact_trace_is_drawn_as_it_was(spark):
    rows = noise(1) + noise(2, 9, 30, 2, 1) + [(2, 0, 0, 0, 8, 8, 8, 0)]
    traced = trace.trace(spark.createDataFrame(rows, PIXELS), params.Options(class_override="Logo", detail=1.0, lock_palette=()), epsilon=0.0)
    for column in (F.col("svg"), paths.optimized_svg(F.col("svg"))):
        got = draw.draw(traced.select(F.col("image_id").alias("svg_id"), column.alias("svg"))).select("image_id", "i", "x", "y", "r", "g", "b", "a")
        assert sorted(map(tuple, got.collect())) == sorted((*r[:4], *([c - c % 2 for c in r[4:7]] if r[7] else (0, 0, 0)), r[7]) for r in rows)


def unpacked(png):
    at, body, size = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + data) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
        size, body, at = struct.unpack(">IIBBBBB", data) if kind == b"IHDR" else size, body + data if kind == b"IDAT" else body, at + 12 + n
    raw = zlib.decompress(body)
    w, h = size[:2]
    assert size[2:] == (8, 6, 0, 0, 0) and all(raw[y * (1 + 4 * w)] == 0 for y in range(h))
    return w, h, b"".join(raw[y * (1 + 4 * w) + 1 : (y + 1) * (1 + 4 * w)] for y in range(h))


def test_svgs_become_png_files(spark):
    svg = '<svg width="4" height="3"><path d="M0 0H3V3H0Z M1 1V2H2V1Z" fill="#ff0000"/><path fill="#0000ff" d="M2 0L4 0 4 1 2 1z"/></svg>'
    svgs = spark.createDataFrame([(1, svg), (2, "<svg/>"), (3, "no xml"), (4, None)], "svg_id long, svg string")
    (row,) = draw.render_png(svgs).collect()
    red, blue, none = (255, 0, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert unpacked(bytes(row["png"])) == (4, 3, bytes(v for p in [red, red, blue, blue, red, none, red, none, red, red, red, none] for v in p))


# --- palettes and despeckling ---


def brute_boxes(values, k):
    error = lambda m: round(float(((values[m] - values[m].mean(0)) ** 2).sum()), 9)
    boxes = [np.arange(len(values))]
    while len(boxes) < k and any(len(m) > 1 for m in boxes):
        _, worst = max((error(m), j) for j, m in enumerate(boxes) if len(m) > 1)
        own = boxes[worst]
        boxes[worst] = boxes[-1]
        boxes.pop()
        own = own[np.argsort(values[own, int(np.ptp(values[own], axis=0).argmax())], kind="stable")]
        boxes += [own[: len(own) // 2], own[len(own) // 2 :]]
    return [m.tolist() for m in boxes]


def test_median_cut_of_many_images_is_that_of_each():
    r = np.random.default_rng(5)
    images = [np.round(r.uniform(0, 1, (n, 3)), 1) for n in (1, 2, 7, 60, 33)]
    targets = np.array([1, 2, 4, 9, 16])
    starts = np.cumsum([0, *[len(x) for x in images[:-1]]])
    rows, begin, size = palette.cut_boxes(np.concatenate(images), starts, targets)
    made = [rows[a : a + n].tolist() for a, n in zip(begin, size)]
    for start, values, k in zip(starts.tolist(), images, targets):
        own = [[i - start for i in box] for box in made if start <= min(box) < start + len(values)]
        assert own == brute_boxes(values, int(k))


def test_despeckling_goes_from_strip_to_strip(spark, monkeypatch):
    monkeypatch.setattr(components, "STRIP", 4)
    r = random.Random(12)
    grid = [[r.randrange(3) for _ in range(11)] for _ in range(30)]
    rows = [(0, y * 11 + x, x, y, grid[y][x]) for y in range(30) for x in range(11)]
    cells = spark.createDataFrame(rows, "image_id long, i long, x int, y int, pid int")
    from test_raster import brute_islands

    want = brute_islands(grid, 4)
    limits = spark.createDataFrame([(0, 4)], "image_id long, min_region int")
    for most in (4, limits):
        got = {(x["x"], x["y"]): x["pid"] for x in components.despeckle(cells, most).collect()}
        assert all(got[x, y] == want[y][x] for y in range(30) for x in range(11))


# --- sweeps ---


def test_a_sweep_is_each_trace(spark):
    pixels = spark.createDataFrame(noise(3) + noise(4, 12, 12, 2, 7), PIXELS)
    specs = [("two", {"k": 2}), ("bad", {"class_override": "Cat"}), ("bw", {"bw_mode": True}), ("free", {"lock_palette": ()}), ("lock", {"lock_palette": ((0, 0, 0), (180, 90, 0))}), ("fine", {"detail": 1.0, "gradients": True})]
    got = {(r["name"], r["image_id"]): (r["svg"], r["stats"], r["error"]) for r in trace.sweep(pixels, variations=specs).collect()}
    assert len(got) == 12
    for name, patch in specs:
        if name == "bad":
            assert all(got[name, i][0] is None and "Cat" in got[name, i][2] for i in (0, 7))
            continue
        from dataclasses import replace

        for r in trace.trace(pixels, replace(params.EDITOR, **patch)).collect():
            assert got[name, r["image_id"]] == (r["svg"], r["stats"], None)


def test_options_from_a_table(spark):
    rows = [(0, "a", None, 3, None), (1, "b", "Cat", None, "x"), (2, "c", "Logo", -1, None), (3, "d", "Photo", None, None)]
    table = spark.createDataFrame(rows, "variant int, name string, class_override string, k int, photo_mode string")
    got = {r["name"]: r for r in trace.checked_options(table).collect()}
    assert got["a"]["error"] is None and got["a"]["detail"] == params.EDITOR.detail and got["a"]["bw_mode"] is False
    assert got["b"]["error"] == "invalid options: class Cat; invalid options: photo mode x" and got["c"]["error"] == "invalid options: k -1" and got["d"]["error"] is None


def test_an_empty_table_gives_no_trace(spark):
    assert trace.trace(spark.createDataFrame([], PIXELS)).collect() == []


def test_foreign_svgs(spark):
    texts = ["<svg width='3'><g><g><path d='M0' fill='#AABBCC'/></g><path fill='red' d='M1'/></g><!-- <path d='M2' fill='#000000'/> --></svg>", "<svg><path d='M0' fill='#aabbcc'", "", None, "<html/>", '<svg viewBox="0 0 7.5 9"><path\n fill="#00ff00"\n\td="M1 &lt;"/></svg>']
    svgs = spark.createDataFrame(list(enumerate(texts)), "svg_id long, svg string")
    got = layers.parse_layers(svgs)
    assert sorted((r["svg_id"], r["d"]) for r in got.shapes.collect()) == [(0, "M0"), (5, "M1 <")]
    assert sorted((r["svg_id"], r["width"], r["height"]) for r in layers.svg_size(svgs).collect()) == [(0, 3, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 7.5, 9)]
    assert re.fullmatch("#[0-9a-f]{6}", got.layers.filter("svg_id = 0").first()["color"])


def test_each_svg_is_parsed_once_and_without_a_tree(spark):
    texts = [
        "<svg width='3'/>and more",
        '<!DOCTYPE svg [<!ENTITY c "#aabbcc">]><svg width="1"><path d="M0" fill="&c;"/></svg>',
        '<g><svg height="4"><svg width="9"/><path d="M1" fill="#000001"/></svg><path d="M2" fill="#000002"/><svg><path d="M3" fill="#000003"/></svg></g>',
        '<?xml version="1.0" encoding="latin-1"?><a:svg xmlns:a="u" width="2"><a:g><a:path fill="#000004" d="M é"/></a:g></a:svg>',
        '<svg><path d="&no;" fill="#000000"/></svg>',
    ]
    read = layers.read_svgs(spark.createDataFrame(list(enumerate(texts)), "svg_id long, svg string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and "from_xml" not in plan
    assert sorted(map(tuple, read.drop("paths").collect())) == [(0, 0, 0), (1, 1, 0), (2, 0, 4), (3, 2, 0), (4, 0, 0)]
    assert sorted((r["svg_id"], r["d"], r["color"]) for r in layers.paths_read(read).collect()) == [(1, "M0", "#aabbcc"), (2, "M1", "#000001"), (3, "M é", "#000004")]


# --- blending and curves ---


def brute_blend(grid, colors, limit):
    """Rounds of merging mutual nearest neighbours, over a dict of regions."""
    h, w = len(grid), len(grid[0])
    comp, members = {}, {}
    for y in range(h):
        for x in range(w):
            if (x, y) not in comp:
                root, stack = y * w + x, [(x, y)]
                comp[x, y] = root
                while stack:
                    a, b = stack.pop()
                    members.setdefault(root, []).append((a, b))
                    for q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= q[0] < w and 0 <= q[1] < h and q not in comp and grid[q[1]][q[0]] == grid[b][a]:
                            comp[q] = root
                            stack.append(q)
    mean = {k: np.array(colors[grid[m[0][1]][m[0][0]]], float) for k, m in members.items()}
    size = {k: len(m) for k, m in members.items()}
    near = {tuple(sorted((comp[p], comp[q]))) for p in comp for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in comp and comp[p] != comp[q]}
    root = {k: k for k in members}
    while True:
        open_ = [(round(float(np.sqrt(((mean[u] - mean[v]) ** 2).sum())), 6), u, v) for u, v in near]
        best = {}
        for e in sorted(e for e in open_ if e[0] < limit):
            for k in e[1:]:
                best.setdefault(k, e)
        pairs = {e for e in best.values() if best[e[1]] == e and best[e[2]] == e}
        if not pairs:
            return {p: (root[k], tuple(int(np.floor(v + 0.5)) for v in mean[root[k]])) for p, k in comp.items()}
        into = {v: u for _, u, v in pairs}
        for v, u in into.items():
            mean[u] = (mean[u] * size[u] + mean[v] * size[v]) / (size[u] + size[v])
            size[u] += size[v]
        root = {k: into.get(r, r) for k, r in root.items()}
        near = {tuple(sorted((into.get(u, u), into.get(v, v)))) for u, v in near}
        near = {e for e in near if e[0] != e[1]}


def test_near_regions_merge_as_by_hand(spark):
    from pixelweave.operators import blend

    r = random.Random(6)
    colors = [(0, 0, 0), (20, 10, 0), (60, 60, 60), (90, 70, 70), (250, 250, 250)]
    grids = [[[r.randrange(5) for _ in range(9)] for _ in range(8)] for _ in range(2)]
    rows = [(k, y * 9 + x, x, y, *colors[g[y][x]], g[y][x]) for k, g in enumerate(grids) for y in range(8) for x in range(9)]
    cells = spark.createDataFrame(rows, "image_id long, i long, x int, y int, r int, g int, b int, pid int")
    labelled = components.components(cells, ["pid"])
    limits = spark.createDataFrame([(0, 60), (1, None)], "image_id long, layer_difference int")
    ends = blend.merge_regions(labelled, limits)
    got = {(x["image_id"], x["x"], x["y"]): (x["root"], (x["mr"], x["mg"], x["mb"])) for x in labelled.join(ends.withColumnsRenamed({"r": "mr", "g": "mg", "b": "mb"}), ["image_id", "comp"]).collect()}
    for k, limit in ((0, 60), (1, 0)):
        want = brute_blend(grids[k], colors, limit)
        assert all(got[k, x, y] == want[x, y] for x, y in want)


def test_settings_shape_the_trace(spark):
    rows = [(0, y * 24 + x, x, y, *((200, 40 + 12 * (x // 8), 40) if (x - 12) ** 2 + (y - 12) ** 2 < 90 else (30, 30, 30)), 255) for y in range(24) for x in range(24)]
    pixels = spark.createDataFrame(rows, PIXELS)
    plain, merged, curved = (trace.trace(pixels, params.Options(class_override="Logo", detail=0.5, lock_palette=()), **how).first() for how in ({}, {"blend_layers": True}, {"curves": True}))
    assert merged["stats"]["path_count"] < plain["stats"]["path_count"] == curved["stats"]["path_count"]
    assert "C" in re.sub("[^A-Z]", "", curved["svg"].split("viewBox")[1]) and "C" not in re.sub('="#\\w+"', "", plain["svg"].split("viewBox")[1])
    drawn = [{(r["x"], r["y"]) for r in draw.draw(spark.createDataFrame([(0, x["svg"])], "svg_id long, svg string")).filter("r > 100").collect()} for x in (plain, curved)]
    assert len(drawn[0] ^ drawn[1]) < 0.15 * len(drawn[0])
