"""Rasters and the pixel relation ``pixels(image_id, i, x, y, r, g, b, a)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST_EDGE = 2000
FORMATS = ("png", "jpg", "jpeg", "gif", "bmp")


def depth_of(rasters: DataFrame):
    """Bytes of a channel: the column ``depth`` (1, or 4 for signed big-endian channels), else 1."""
    return F.col("depth") if "depth" in rasters.columns else F.lit(1)


def validated(rasters: DataFrame) -> DataFrame:
    """``rasters(image_id, width, height, data)`` with ``error``: null, or what is wrong with the buffer."""
    expected = F.col("width").cast("long") * F.col("height") * 4 * depth_of(rasters)
    bad = F.when((F.col("width") <= 0) | (F.col("height") <= 0), "empty image").when(F.coalesce(F.length("data"), F.lit(-1)) != expected, "buffer does not match dimensions")
    return rasters.withColumn("error", bad)


def explode_rasters(rasters: DataFrame) -> DataFrame:
    """Pixels of all valid row-major RGBA buffers, with JVM functions only; invalid ones give none."""
    good = validated(rasters).filter("error is null").withColumn("depth", depth_of(rasters))
    each = good.select("image_id", "width", "data", "depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)).alias("i"))
    size = F.col("depth") * 4
    quad = F.hex(F.substring("data", (F.col("i") * size + 1).cast("int"), size))
    told = lambda k: F.conv(F.substring(quad, F.col("depth") * (2 * k) + 1, F.col("depth") * 2), 16, 10).cast("long")
    channel = lambda k: F.when(told(k) < 1 << 31, told(k)).otherwise(told(k) - (1 << 32)).cast("int")
    return each.select("image_id", "i", (F.col("i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[channel(k).alias(c) for k, c in enumerate("rgba")])


def collect_rasters(pixels: DataFrame) -> DataFrame:
    """The inverse of :func:`explode_rasters`: one buffer per image, which a row has to hold; bring larger images down first.

    ``depth`` is 1, or 4 for an image with a channel that is no byte, so that
    every channel comes back as it was.
    """
    digits = lambda c, n: F.lpad(F.hex(F.col(c).cast("long").bitwiseAND(F.lit((1 << 32) - 1))), n, "0")
    bytes_ = F.greatest(*[F.col(c) for c in "rgba"]).between(0, 255) & F.least(*[F.col(c) for c in "rgba"]).between(0, 255)
    own = pixels.withColumn("q", F.when(bytes_, F.concat(*[digits(c, 2) for c in "rgba"])).otherwise(F.concat(*[digits(c, 8) for c in "rgba"])))
    wide = lambda q: F.when(F.length(q) == 8, F.concat(*[p for k in range(4) for p in (F.lit("000000"), F.substring(q, 2 * k + 1, 2))])).otherwise(q)
    made = own.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("i", "q"))).alias("quads"), F.when(F.max(F.length("q")) > 8, 4).otherwise(1).alias("depth"))
    text = F.when(F.col("depth") == 1, F.array_join(F.transform("quads", lambda q: q["q"]), "")).otherwise(F.array_join(F.transform("quads", lambda q: wide(q["q"])), ""))
    return made.select("image_id", "width", "height", F.unhex(text).alias("data"), "depth")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Encoded image files as ``rasters(image_id, name, width, height, data)``.

    The JVM's decoders give B, G, R(, A) rows; grey images repeat their
    channel and images without alpha are opaque. Files that do not decode are
    dropped by the source. ``image_id`` is a hash of the path.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n = F.col("nChannels")
    offsets = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    byte = lambda i, k: F.hex(F.substring("data", i * n + F.lit(k), F.lit(1)))

    def quad(i):
        colour = F.concat(byte(i, 3), byte(i, 2), byte(i, 1))
        return F.when(n == 1, F.concat(byte(i, 1), byte(i, 1), byte(i, 1), F.lit("FF"))).when(n == 3, F.concat(colour, F.lit("FF"))).otherwise(F.concat(colour, byte(i, 4)))

    data = F.unhex(F.array_join(F.transform(offsets, quad), ""))
    return rows.select(F.xxhash64("origin").alias("image_id"), F.element_at(F.split("origin", "/"), -1).alias("name"), "width", "height", data.alias("data"))


def first_images(files: DataFrame) -> DataFrame:
    """The file that counts of each drop of ``files(drop_id, place, name, mime)``: its first, if that is an image; else none."""
    first = files.groupBy("drop_id").agg(F.min_by(F.struct("name", "mime"), "place").alias("f"))
    return first.filter(F.startswith(F.col("f.mime"), F.lit("image/"))).select("drop_id", "f.name", "f.mime")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(name, width, height)`` of encoded images; the bytes are pruned from the result."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image.width", "image.height")


def fitted_size(width, height, longest: int = LONGEST_EDGE):
    """Sides after the longest is brought down to the limit."""
    ratio = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.round(side * ratio).cast("int")) for side in (width, height))


def downsample(pixels: DataFrame, longest: int = LONGEST_EDGE) -> DataFrame:
    """Area average to the fitted size; alpha weighs the colours. Images within the limit are unchanged."""
    sides = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    w, h = fitted_size(F.col("w"), F.col("h"), longest)
    sides = sides.select("image_id", "w", "h", w.alias("nw"), h.alias("nh"))
    moved = pixels.join(sides, "image_id").withColumns({"nx": F.floor(F.col("x") * F.col("nw") / F.col("w")).cast("int"), "ny": F.floor(F.col("y") * F.col("nh") / F.col("h")).cast("int")})
    weight = F.sum("a")
    mean = lambda c: F.when(weight > 0, F.round(F.sum(F.col(c) * F.col("a")) / weight)).otherwise(F.round(F.avg(c))).cast("int").alias(c)
    out = moved.groupBy("image_id", "nx", "ny", "nw").agg(*map(mean, "rgb"), F.round(F.avg("a")).cast("int").alias("a"))
    return out.select("image_id", (F.col("ny").cast("long") * F.col("nw") + F.col("nx")).alias("i"), F.col("nx").alias("x"), F.col("ny").alias("y"), "r", "g", "b", "a")


# --- rasters derived from the test tables ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(i, width: int):
    return [i.alias("i"), (i % width).cast("int").alias("x"), F.floor(i / width).cast("int").alias("y")]


def order_pixels(spark: SparkSession, sf_dir: str, image_id: int = 0) -> DataFrame:
    """A noisy raster 100 wide: price, priority and customer as channels, open orders transparent."""
    o = table(spark, sf_dir, "orders")
    red = F.floor(F.col("o_totalprice") / 500000 * 255).cast("int")
    green = F.substring("o_orderpriority", 1, 1).cast("int") * 51
    return o.select(F.lit(image_id).cast("long").alias("image_id"), *grid(F.col("o_orderkey"), 100), red.alias("r"), green.alias("g"), (F.col("o_custkey") % 256).cast("int").alias("b"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(255).alias("a"))


def order_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, i, x, y, pid)``: the order raster in 16 levels of price."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit(0).cast("long").alias("image_id"), *grid(F.col("o_orderkey"), 100), F.floor(F.col("o_totalprice") / 500000 * 15).cast("int").alias("pid"))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grey tile per embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "v"))
    grey = F.floor((F.col("v").cast("double") + 0.6) / 1.2 * 255).cast("int")
    return e.select("image_id", *grid(F.col("k").cast("long"), 8), *[grey.alias(c) for c in "rgb"], F.lit(255).alias("a"))


def event_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, i, x, y, on)``: where the event is an error, 100 wide."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("image_id"), *grid(F.col("event_id"), 100), (F.col("event_type") == "error").alias("on"))


def ramp_pixels(spark: SparkSession, sf_dir: str, image_id: int = 0) -> DataFrame:
    """A smooth grey ramp along x, on the order raster's grid."""
    o = table(spark, sf_dir, "orders")
    grey = (F.floor((F.col("o_orderkey") % 100) * 120 / 99) + 80).cast("int")
    return o.select(F.lit(image_id).cast("long").alias("image_id"), *grid(F.col("o_orderkey"), 100), *[grey.alias(c) for c in "rgb"], F.lit(255).alias("a"))


# --- sinks ---


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line per image: ``{"svg": …, "stats": {…}}``."""
    results.select(F.to_json(F.struct("image_id", "svg", "stats")).alias("value")).write.text(path)


def write_svgs(results: DataFrame, path: str) -> None:
    """One folder ``name=<base>.svg`` per image that holds its text; ``results(name, svg)``."""
    from pixelweave.functions.text import base_name

    results.select(F.concat(base_name(F.col("name")), F.lit(".svg")).alias("name"), F.col("svg").alias("value")).write.partitionBy("name").text(path)
