"""Nests over streams: the same definition, fed incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.nest import Nest


def events_stream(spark: SparkSession, path: str, schema: StructType, watermark: tuple[str, str] | None = None, files_per_trigger: int | None = None, glob: str = "*.parquet") -> DataFrame:
    """A stream of the files of a folder whose names match; watermark: (time column, delay)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.parquet(path)
    if watermark:  # watermarks need a zoned type; times without one are read as session time
        out = out.withColumn(watermark[0], F.col(watermark[0]).cast("timestamp")).withWatermark(*watermark)
    return out


def run_to_table(nest: Nest, stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Feeds all that is there, batch by batch, into a Parquet table at path and reads it.

    In complete mode each batch replaces the table; in update mode it writes the
    groups that changed to a partition of its own, `batch`, so that a batch that is
    replayed after a failure replaces what it wrote. A stream without a batch gives
    an empty frame.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    frame = nest.frame(stream)
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    spark = stream.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        empty = spark.createDataFrame([], frame.schema)
        return empty if mode == "complete" else empty.withColumn("batch", F.lit(0).cast("long"))
    out = spark.read.parquet(path)
    return out if mode == "complete" else out.withColumn("batch", F.col("batch").cast("long"))
