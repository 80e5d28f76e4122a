"""Traces of rasters that arrive as files. An extension: parity needs no stream.

Images are independent, so a micro-batch is a batch of whole images and no
state is kept between batches. A batch that is run again after a failure
replaces its own folder, so every image is traced once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelweave.functions.params import DEFAULT, Options
from pixelweave.plans.trace import trace
from pixelweave.sources.rasters import explode_rasters

RASTERS = "image_id long, width int, height int, data binary"


def raster_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of ``rasters`` from Parquet files that are added to a folder."""
    return spark.readStream.schema(RASTERS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def trace_stream(stream: DataFrame, path: str, checkpoint: str, options: Options = DEFAULT) -> StreamingQuery:
    """Trace what there is, batch by batch, into ``path/batch=<n>``, then stop."""

    def each(batch: DataFrame, n: int) -> None:
        trace(explode_rasters(batch), options).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
