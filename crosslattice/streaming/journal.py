"""The journal as a stream: deduplicated within a watermark, accounted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """First delivery of each key within the allowed lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_accounting(stream: DataFrame, time: str, lateness: str, window: str, group: str, value: str) -> DataFrame:
    """Count, sum and mean of a value by tumbling window and group."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, window), group)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), group, "n", "total", "mean")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is, once, appended as Parquet; a restart goes on where the last run ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
