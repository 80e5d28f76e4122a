"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte of a UTF-8 text alone.
LOWER_AZ = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a
    temporary folder is made, and remembered in the session; on a cluster a
    session without that setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pixelweave.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelweave-")
        spark.conf.set("pixelweave.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/pixelweave/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote, through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Writer's option for rows of some hundred kilobytes: so many make a row group. A task holds a group's pages and columns
#: at once, and by default a group's size is first looked at when it has 100 rows.
WIDE_ROWS = {"parquet.block.row.count.limit": 16}


def materialize(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet, with a writer's ``options``, into the shared folder and read it again.

    It cuts the lineage like a checkpoint: what is lost with an executor is
    read again from the shared files.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables once everything that is read from them has been written itself."""
    for t in tables:
        remove_path(t.sparkSession, t.written_to)


def limited(small: DataFrame, most: int = 50_000, values: str = "1") -> DataFrame:
    """Broadcast hint for a written table that holds ``most`` values at most (rows, if nothing else is said); above it Spark's own join choice holds."""
    held = small.agg(F.sum(F.expr(values))).first()[0] or 0
    return F.broadcast(small) if held <= most else small


def rows_kept(docs: DataFrame, groups: DataFrame, id_col: str, text: str) -> DataFrame:
    """The documents, with all their columns, that stay when each group keeps one: that with the smallest id.

    ``groups(id, mark, group)`` has a row per document, ``mark`` being
    ``xxhash64`` of its text. Null ids come last; of one id's texts in a group
    the smallest mark stays. Rows that share their id in different groups are
    different documents. Of rows that share id and text the one with the
    smallest hash over all columns stays.
    """
    counted = groups.groupBy("group", "id", "mark").agg(F.count("*").alias("n"))
    first = counted.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark", "n")).alias("first"))
    kept = materialize(first.select(F.col("first.id").alias("of"), F.col("first.mark").alias("of_mark"), F.col("first.n").alias("n")), "kept")
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))
    # What goes, and what stays once of several rows, is less than what stays: the texts meet these two tables only.
    gone = materialize(counted.select("id", "mark").join(kept, same, "left_anti").withColumnsRenamed({"id": "of", "mark": "of_mark"}), "gone")
    several = materialize(kept.filter("n > 1").drop("n"), "several")
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(blank(F.col(text))).alias("mark"))
    alone = own.join(limited(gone.unionByName(several), 300_000), same, "left_anti").select("row.*")
    once = own.join(limited(several, 300_000), same, "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return alone.unionByName(once.select("row.*"))


#: Functions that hold memory from task to task in a Python worker; each has ``cache_clear``.
HELD: list = []


def forget() -> None:
    """Called where a task of another operator begins: let go of what earlier ones hold in this worker."""
    for held in HELD:
        held.cache_clear()
    give_back()


def give_back() -> None:
    """Return memory that this worker's allocators keep but do not use, so that it is not added up over tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows, and so the text, that one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deal rows out evenly by the hash of their keys."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, case kept."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(column) -> F.Column:
    """The text, or an empty text for null."""
    return F.coalesce(column, F.lit(""))


def local_name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))
