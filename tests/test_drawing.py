"""Drawing reads each SVG once and shuffles crossings, not pixels; path data becomes flat buffers."""

from pyspark.sql import functions as F

from pixelweave.functions import params, paths
from pixelweave.plans import draw, trace


def test_each_svg_is_read_once_and_pixels_meet_no_join(spark):
    texts = [(1, '<svg width="3" height="2"><path d="M0 0L2 0L2 2L0 2Z" fill="#102030"/><path d="M1 1L3 1L3 2L1 2Z" fill="#405060" transform=""/></svg>'), (2, '<svg width="2" height="1"/>'), (3, "<svg"), (4, None)]
    drawn = draw.draw(spark.createDataFrame(texts, "svg_id long, svg string"))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and "from_xml" not in plan
    assert not any(" x#" in line for line in plan.splitlines() if "Join" in line or "hashpartitioning" in line)
    low, high, none = (16, 32, 48, 255), (64, 80, 96, 255), (0, 0, 0, 0)
    want = {(1, 0): low, (1, 1): low, (1, 2): none, (1, 3): low, (1, 4): high, (1, 5): high, (2, 0): none, (2, 1): none}
    assert {(r["image_id"], r["i"]): (r["r"], r["g"], r["b"], r["a"]) for r in drawn.collect()} == want and drawn.count() == len(want)


def test_images_that_are_all_black_and_white_do_not_meet_the_settings(spark):
    tiles = spark.range(4 * 6).selectExpr("id div 4 AS image_id", "id % 4 AS i", "CAST(id % 2 AS INT) AS x", "CAST(id % 4 div 2 AS INT) AS y", *[f"CAST(id * 37 % 256 AS INT) AS {c}" for c in "rgb"], "255 AS a")
    seen = []
    before = trace.trace_bw
    try:
        trace.trace_bw = lambda pixels, **how: seen.append(pixels) or before(pixels, **how)
        traced = trace.trace(tiles, params.Options(bw_mode=True), epsilon=0.0)
    finally:
        trace.trace_bw = before
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    drawn = draw.draw(traced.select(F.col("image_id").alias("svg_id"), "svg")).select("image_id", "i", "a")
    dark = tiles.select("image_id", "i", F.when(F.col("r") < 128, 255).otherwise(0).alias("a"))
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, dark.collect()))


def test_plain_paths_are_cut_as_they_are_read():
    texts = ["M0 0L8 0L8 3Z", "M0 0L1 0L1 1ZM-2.5 3L4 0.25L1 1Z", "M7 7Z", "", None, "M1 2L3 4 5,6Z", "m1 1l2 0 0 2-2 0zl5 5", "M1 1C2 2 3 3 4 4L5 5", "M1 2L3 4", "M1.2.3L4 5Z", "M1 1L2 2ZL5 5Z"]
    want = [None if t is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in paths.read_path(t)] for t in texts]
    assert paths.rings_of(texts).to_pylist() == want
    assert paths.rings_of([]).to_pylist() == [] and paths.rings_of([None]).to_pylist() == [None]
