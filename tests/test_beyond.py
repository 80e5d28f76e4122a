"""Values and sizes that the small tables do not have: channels that are no bytes, images higher than 2000 pixels, halves at the last place."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import shared
from pixelweave.operators import components, gradient, stencil
from pixelweave.plans import draw, edits, layers, trace
from pixelweave.queries import EXACT, ORACLE, QUERIES, rounded


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Embeddings of which one leads to channels below 0 and one to some above 255."""
    d = str(tmp_path_factory.mktemp("wide"))
    rows = [(k, [float(((k + 1) * j % 23 - 11) / 20) for j in range(64)], 0) for k in range(3)]
    rows[1][1][12], rows[2][1][7], rows[2][1][8] = -0.63, 0.71, -0.9
    con = duckdb.connect()
    con.execute("CREATE TABLE e(vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    con.execute(f"COPY e TO '{d}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"COPY (FROM '/root/testdata/sf0.001/region.parquet') TO '{d}/region.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", ["raster_round_trip", "sweep_redrawn", "quantize_palette"])
def test_channels_that_are_no_bytes_are_kept(spark, wide, name):
    con = duckdb.connect()
    for t in ("embeddings", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{wide}/{t}.parquet'")
    got = QUERIES[name](spark, wide)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_an_image_over_the_longest_edge_is_drawn_whole(spark):
    tall = spark.range(2 * 2100).select(F.lit(7).cast("long").alias("image_id"), F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("x"), F.floor(F.col("id") / 2).cast("int").alias("y"), *[(F.col("id") * m % 8 * 30).cast("int").alias(c) for m, c in ((3, "r"), (5, "g"), (7, "b"))], F.lit(255).alias("a"))
    shapes = trace.trace_paths(tall, EXACT, epsilon=0.0).selectExpr("image_id AS svg_id", "struct(z, comp) AS seq", "d", "color")
    sizes = stencil.image_sizes(tall).selectExpr("image_id AS svg_id", "w AS width", "h AS height")
    drawn = draw.draw_shapes(shapes, sizes).select("i", "r", "g", "b", "a")
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, tall.select("i", "r", "g", "b", "a").collect()))


def test_halves_at_the_last_place_round_as_in_sql(spark):
    values = [k / 10_000_000 for k in range(5_000_005, 5_008_000, 10)]
    want = [r[0] for r in duckdb.sql(f"SELECT round(unnest({values!r}::DOUBLE[]), 6)").fetchall()]
    made = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    assert [r["v"] for r in made.select("k", *rounded("v")).orderBy("k").collect()] == want


def test_pixels_of_a_region_are_not_brought_together(spark):
    region = spark.range(4000).selectExpr("0L AS image_id", "0L AS comp", "id AS i", "CAST(id % 80 AS INT) AS x", "CAST(id div 80 AS INT) AS y", "id % 80 / 100D AS l", "0D AS oa", "0D AS ob")
    binned = gradient.projected(region, gradient.axes(gradient.normal_equations(region)))
    plan = binned._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert gradient.gates(binned).first()["accepted"]


def test_despeckling_in_shares_is_that_of_one_scan(spark):
    cells = spark.range(40 * 60).selectExpr("0L AS image_id", "id AS i", "CAST(id % 40 AS INT) AS x", "CAST(id div 40 AS INT) AS y", "CAST(pmod(xxhash64(id), 6) AS INT) AS pid")
    one, many = (sorted(map(tuple, components.despeckle(cells, 4, share=n).collect())) for n in (1 << 17, 64))
    assert one == many and len(one) == 40 * 60


def test_a_chain_down_the_whole_image_is_handed_on(spark):
    """A column of single cells, each of which waits for the one above, over more shares than were rounds allowed for."""
    pid = "CASE WHEN id % 3 = 1 THEN 10 + id div 3 % 2 WHEN id < 3 THEN 5 ELSE CASE WHEN id % 3 = 0 THEN 6 ELSE 7 END END"
    cells = spark.range(3 * 40).selectExpr("0L AS image_id", "id AS i", "CAST(id % 3 AS INT) AS x", "CAST(id div 3 AS INT) AS y", f"CAST({pid} AS INT) AS pid")
    one, many = (sorted(map(tuple, components.despeckle(cells, 1, share=n).collect())) for n in (1 << 17, 3))
    assert one == many


def test_replaying_holds_a_bounded_number_of_shapes(spark):
    shapes = spark.range(60).selectExpr("id div 20 AS svg_id", "CAST(id % 20 AS INT) AS seq", "'M0 0Z' AS d", "'' AS transform", "CONCAT('layer-', id % 2) AS layer_id")
    listed = spark.range(6).selectExpr("id div 2 AS svg_id", "CAST(id % 2 AS INT) AS pos", "CONCAT('layer-', id % 2) AS layer_id", "'#000000' AS color", "true AS visible", "10L AS count")
    log = spark.range(3).selectExpr("id AS svg_id", "1 AS step", "'remove' AS op", "'layer-1' AS layer", "CAST(null AS string) AS value").filter("svg_id <> 1")
    held = []
    before = edits.AT_ONCE
    try:
        for edits.AT_ONCE in (before, 1, 25):
            out = edits.replay(layers.Model(shapes, listed), log)
            held.append((sorted(map(tuple, out.layers.collect())), sorted(map(tuple, out.shapes.collect()))))
    finally:
        edits.AT_ONCE = before
    assert held[0] == held[1] == held[2] and len(held[0][1]) == 40


def test_a_written_table_is_not_broadcast_for_its_small_file(spark):
    many = spark.range(1_000_000).selectExpr("pmod(xxhash64(id), 1000) AS k", "pmod(xxhash64(id, 1), 7) AS v")
    left, right = shared.materialize(many, "left"), shared.materialize(many.withColumnRenamed("v", "w"), "right")
    plan = left.join(right, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_sizes_of_svgs_with_some_attributes(spark):
    svgs = spark.createDataFrame([(1, '<svg width="3px" viewBox="0 0 9 8"/>'), (2, "<svg"), (3, '<v:svg xmlns:v="u" viewBox="0 0 9 8.5" height="2"/>'), (4, None)], "svg_id int, svg string")
    sizes = layers.svg_size(svgs)
    assert sorted(map(tuple, sizes.collect())) == [(1, 3.0, 8.0), (2, 0.0, 0.0), (3, 9.0, 2.0), (4, 0.0, 0.0)]


def test_groups_stay_whole_behind_a_join_that_becomes_a_broadcast(spark):
    """The join is planned as one of two shuffles, as its sides could be large, and turns into a broadcast."""
    cells = spark.range(0, 40_000_000, 1, 8).filter("id % 40 = 3").selectExpr("id div 40 % 500 AS k", "id AS i")
    few = spark.range(5_000_000).filter("id % 10000 = 7").selectExpr("id div 10000 AS k", "id AS of")
    counted = shared.by_batch(cells.join(few, "k"), ["k"], ["i"], lambda pdf: pdf.groupby("k", as_index=False).agg(n=("of", "count")), "k long, n long")
    assert sorted(map(tuple, counted.collect())) == [(k, 2000) for k in range(500)]
