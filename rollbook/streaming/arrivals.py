"""Records that arrive by and by: stored once each, and counted by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.records import new_versions


def arrivals(spark: SparkSession, folder: str, schema: StructType | str, files_each: int = 1000) -> DataFrame:
    """A stream of the JSON lines of files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def store_new(stream: DataFrame, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append the records whose key isn't stored yet, and end when all that has arrived is taken.

    Each batch writes its own partition anew, so one that is run again after a failure leaves nothing twice, not even
    the records with a null in their key, which always count as new.
    """
    schema = StructType([*stream.schema.fields]).add("batch", "long")

    def store(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        known = spark.read.schema(schema).parquet(table).where(F.col("batch") != number) if number else spark.createDataFrame([], schema)
        new_versions(rows, known, keys).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n) by windows of event time; what comes later than ``late`` isn't counted any more, which bounds the state."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")
