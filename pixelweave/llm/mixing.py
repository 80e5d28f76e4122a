"""Mixing sources to target weights by repetition rates.

Everything is an aggregate, a running sum over ranges of the sources, or an
expression on the document's own row; no row-level shuffle is needed.

A document of a source with rate ``r`` is emitted ``floor(r)`` times, plus
once more if its hash-seeded uniform number is below the fraction of ``r``.
``SEEDS`` seeds are tried in one aggregation and each source uses the seed
whose total is nearest to its target: still one fixed hash draw per document,
but the mix comes closer to the target than a single arbitrary seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import limited, materialize

SEEDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed, key) -> F.Column:
    """A number in [0, 1) from MD5 over ``seed:key``; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def sums_before(rows: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with, for each new column of ``sums``, the sum of an old one over all rows that stand before in ``order``.

    Rows are dealt into ranges of the order and written; a range is summed on
    its own and begins with the totals of the ranges before it, a row each.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id()), name)
    totals = ranged.groupBy(F.col("range_no").alias("of_range")).agg(*[F.sum(old).alias(new) for new, old in sums.items()])
    earlier, inside = Window.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.select("of_range", *[F.coalesce(F.sum(new).over(earlier), F.lit(0)).alias(f"{new}_begun") for new in sums])
    joined = ranged.join(F.broadcast(begun), F.col("range_no") == F.col("of_range"))  # a row per range
    return joined.select(*rows.columns, *[(F.col(f"{new}_begun") + F.coalesce(F.sum(old).over(inside), F.lit(0))).alias(new) for new, old in sums.items()])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, take the weights in turn. ``share`` of
    all sizes is dealt out by weight; no target exceeds ``most`` times its
    source's size, and what is above is dealt to the others by weight, until
    none is above. In closed form: ``target = min(cap, level * weight)``, where
    the level follows from the sources sorted by ``cap / weight``. Both orders
    are dealt into ranges, so there may be any number of sources. An empty table
    gives an empty table.
    """
    one = sizes.select("source", "source_size", F.lit(1).alias("one"))
    ranked = sums_before(one, [F.col("source").asc_nulls_last()], {"rank": "one"}, "sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.drop("one").withColumn("weight", pick).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = sums_before(capped, ["ratio", "rank"], {"cap_before": "cap", "weight_before": "weight"}, "caps")
    every = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(share)) * F.lit(every["size"] or 0) - F.col("cap_before")) / (F.lit(every["weight"] or 0.0) - F.col("weight_before"))
    opened = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap"))
    first = opened.agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("level")).first()["level"]
    done = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return filled.select("source", "source_size", done.alias("target"))


def rates(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seeds: int = SEEDS) -> DataFrame:
    """One row per source of ``sized(key, source, size)``: its target, whole and fractional rate, and seed."""
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rated = per_source.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
    rated = materialize(rated.select(F.col("source").alias("of"), "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part")), "rates")
    joined = sized.join(limited(rated.select("of", "part")), F.col("source").eqNullSafe(F.col("of")))
    tried = joined.groupBy("of").agg(*[F.sum(F.when(uniform(F.lit(s), F.col("key")) < F.col("part"), F.col("size")).otherwise(0)).alias(f"t{s}") for s in range(seeds)])
    off = lambda s: F.abs(F.col(f"t{s}") + F.col("whole") * F.col("source_size") - F.col("target"))
    nearest = F.array_min(F.array(*[F.struct(F.round(off(s), 3).alias("d"), F.lit(s).alias("seed")) for s in range(seeds)]))
    chosen = rated.join(tried.withColumnRenamed("of", "tried"), F.col("of").eqNullSafe(F.col("tried")))
    return materialize(chosen.select("of", "source_size", "target", "whole", "part", nearest.getField("seed").alias("seed")), "seeds")


def measured(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``key`` (the id as text, empty for null) and ``size`` (words of the text)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({"size": size, "key": F.coalesce(F.col(id_col).cast("string"), F.lit(""))})


def drawn(sized: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sized`` with ``source_size``, ``target``, ``copies`` and ``taken`` by the rates chosen."""
    out = sized.join(limited(chosen), F.col("source").eqNullSafe(F.col("of")))
    copies = (F.col("whole") + F.when(uniform(F.col("seed"), F.col("key")) < F.col("part"), 1).otherwise(0)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("of", "whole", "part", "seed", "key")


def mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)`` of every document.

    ``copies`` is how often the mix emits the document and ``taken`` is that
    times its size. A null text has size 0, a null source is a source of its
    own, a source without words has target 0. Repeated rows share id and
    seed, and so their number of copies. Other columns are not read.
    """
    sized = materialize(measured(docs.select(id_col, "source", "text"), id_col).drop("text"), "sizes")
    return drawn(sized, rates(sized, **how))


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself: every document as often as :func:`mix` says, with the columns of ``docs``."""
    sized = materialize(measured(docs.select(id_col, "source", "text"), id_col).drop("text"), "sizes")
    own = docs.select(F.struct("*").alias("row"), "source", "text", F.col(id_col).alias("id"))
    out = drawn(measured(own, "id").drop("text", "id"), rates(sized, **how)).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
