"""Hourly coverage of readings as a stream: event-time windows with a watermark, written once per micro-batch.

Every micro-batch writes the windows that it changed to a folder named by its number, so a batch that is run again after a
lost executor replaces its own rows; readers take the newest row of each window. Rows that come later than the
watermark allows are left out of closed windows, and their number is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid.session import new_folder


PROGRESS = 100_000  # micro-batches of one call whose late rows are counted


def arriving(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, at most ``files`` of them in a micro-batch."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if alone:  # streams read folders
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def hourly_counts(rows: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(keys, hour_end, n_valid, total) of readings, for a stream or a table; hours are labelled by their end."""
    hour = F.window(ts, "1 hour")
    return rows.groupBy(*keys, hour.alias("_hour")).agg(F.count(value).alias("n_valid"), F.sum(value).alias("total")).select(
        *keys, F.col("_hour.end").alias("hour_end"), "n_valid", "total")


@dataclass
class Coverage:
    """Where the changed windows of all micro-batches lie, and how many rows came too late."""

    spark: SparkSession
    root: str
    schema: T.StructType
    late: int = 0
    batches: int = 0

    def table(self, keys: list[str]) -> DataFrame:
        """The newest row of every window."""
        if not self.batches:
            return self.spark.createDataFrame([], self.schema)
        changed = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).parquet(self.root)
        rest = [c for c in self.schema.names if c not in (*keys, "hour_end")]
        newest = F.max_by(F.struct(*rest), F.col("batch")).alias("_n")
        return changed.groupBy(*keys, "hour_end").agg(newest).select(*keys, "hour_end", "_n.*")


def follow(rows: DataFrame, keys: list[str], ts: str, value: str, delay: str = "1 hour", checkpoint: str | None = None,
           root: str | None = None) -> Coverage:
    """Run a streaming ``rows`` over all that is there now and stop; ``checkpoint`` and ``root`` let a later call go on."""
    spark = rows.sparkSession
    root, checkpoint = root or new_folder(spark, "coverage"), checkpoint or new_folder(spark, "progress")
    counts = hourly_counts(rows.withWatermark(ts, delay), keys, ts, value)
    made = Coverage(spark, root, counts.schema)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    # the late rows of all micro-batches are told by their progress
    remembered = "spark.sql.streaming.numRecentProgressUpdates"
    if int(spark.conf.get(remembered)) < PROGRESS:
        spark.conf.set(remembered, PROGRESS)
    query = (counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    for progress in query.recentProgress:
        made.batches += 1
        made.late += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
    return made
