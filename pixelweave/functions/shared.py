"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and all runs on one machine a temporary folder, remembered in the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pixelweave.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelweave-")
        spark.conf.set("pixelweave.shared.dir", found)
    return found.rstrip("/")


#: How much larger than their files written tables are taken to be when Spark chooses a join by size: numbers of
#: images and components, sorted and in few bits, take a twentieth of a row in memory and less, and a broadcast
#: is made of rows, in the driver.
COMPRESSED = "spark.sql.sources.fileCompressionFactor"
FACTOR = 20.0


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again, which cuts its lineage.

    Where the session has no other, its factor from files to rows is set to
    ``FACTOR``, so that no join broadcasts a table because its file is small.
    """
    conf = df.sparkSession.conf
    if float(conf.get(COMPRESSED, "1.0")) == 1.0:
        conf.set(COMPRESSED, str(FACTOR))
    path = f"{shared_dir(df.sparkSession)}/pixelweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def small(table: DataFrame, rows: int = 2000) -> DataFrame:
    """Broadcast hint for a written table of few rows, behind a count; above it Spark's own join choice holds."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once everything read from them has been written itself."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places of the first rows of the groups of a sorted frame."""
    held = pdf[keys].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)]))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a sorted partition again, cut only where a group ends."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if rest and (pdf[keys].iloc[-1] == rest[0][keys].iloc[0]).all():  # the open group goes on to the end
            rest.append(pdf)
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True)
        last = int(changes(pdf, keys)[-1])
        if last:
            yield pdf.iloc[:last]
        rest = [pdf.iloc[last:].reset_index(drop=True)]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def by_batch(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on frames of many whole groups each, sorted by ``keys`` and ``order``.

    Groups are dealt out over all shuffle partitions, so that a CPU-bound
    kernel is not run in one task because its bytes are few. What is in memory
    is an Arrow batch, or one group where that is larger. They are dealt out by
    a hash of the keys: a shuffle by the keys themselves is left out behind a
    join by the same keys, and where that join becomes a broadcast in the run,
    its shuffle is read in other pieces, which cut groups.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, keys):
            yield kernel(pdf)

    return df.repartition(n, F.hash(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(rows, schema)


def by_group(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on the rows of one group at a time, as :func:`by_batch` deals them out."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds = [*changes(pdf, keys).tolist(), len(pdf)]
        return pd.concat([kernel(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(bounds, bounds[1:])], ignore_index=True)

    return by_batch(df, keys, order, each, schema)


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place ``name`` (from 0) of each row within its ``key``, and the key's number of rows ``n``.

    Rows are dealt out by ranges of key and order and numbered within a range;
    a key's earlier ranges are added. So a key may hold any share of the rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, key, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(key, "range_no").agg(F.count("*").alias("held"))
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum("held").over(own.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small(materialize(held.select(key, "range_no", before.alias("before"), F.sum("held").over(own).alias("n")), "offsets"), 100_000)
    local = F.row_number().over(Window.partitionBy(key, "range_no").orderBy(*order)) - 1
    return dealt.withColumn("local", local).join(offsets, [key, "range_no"]).withColumn(name, F.col("before") + F.col("local")).drop("range_no", "before", "local")
