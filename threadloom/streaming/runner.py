"""Running finite streams to their end, into tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.staging import new_path


def replayed(spark: SparkSession, table: DataFrame, files_per_batch: int | None = None, files: int = 4, order: str | None = None) -> DataFrame:
    """A finite table as a file stream: staged as a few files, ordered by a column across them, and read batch by batch."""
    path = new_path(spark, "stream-input")
    ranged = table.repartitionByRange(files, order).sortWithinPartitions(order) if order else table.repartition(files)
    ranged.write.parquet(path)
    if order:  # file streams go by modification time
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        newest = max((f.getModificationTime() for f in fs.listStatus(folder)), default=0)
        for i, name in enumerate(names):
            fs.setTimes(jvm.org.apache.hadoop.fs.Path(name), newest - 1000 * (len(names) - i), -1)
    reader = spark.readStream.schema(table.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all that is there and return its output."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    query = stream.writeStream.format("parquet").option(
        "checkpointLocation", new_path(spark, f"{name}-state")
    ).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_of_updates(stream: DataFrame, keys: Sequence[str], name: str, mode: str = "update") -> DataFrame:
    """Run an update stream over all that is there and return the last row of each key.

    Every batch is written to a folder of its number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    out = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", new_path(spark, f"{name}-state")
    ).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/*").drop("batch")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_batch")))).filter("_n = 1").drop("_n", "_batch")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], name: str) -> None:
    """Run ``work`` on each micro-batch until the input is used up; at least once per batch, so work must bear repetition."""
    query = stream.writeStream.foreachBatch(work).option(
        "checkpointLocation", new_path(stream.sparkSession, f"{name}-state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
