"""Frames and events as streams: incremental statistics with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import shared_dir


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """kind, begin, n, total of tumbling windows; rows later than the watermark are dropped by a stream."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("kind", F.col("w.start").alias("begin"), "n", "total")
    )


def run_available(spark: SparkSession, path: str, pattern: str, width: str = "1 hour", late: str = "2 hours", files: int = 1000) -> DataFrame:
    """All files of path that match pattern, as a stream until nothing is left.

    Each micro-batch reports the windows that it has changed, and the last report of
    a window counts; so open windows are there too, while the watermark lets the
    state of closed ones go and drops rows that come too late for them.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    stream = windowed(spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path), width, late)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = F.max_by(F.struct("n", "total"), "batch")
    return spark.read.parquet(f"{folder}/out/*").groupBy("kind", "begin").agg(last.alias("r")).select("kind", "begin", "r.n", "r.total")
