"""Structured Streaming: extracted lines as they arrive, each line kept once, and rolling counts by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The line items of a folder of Parquet files, file by file."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))  # a watermark needs a zoned time


def first_extractions(lines: DataFrame, delay: str | None = None) -> DataFrame:
    """Each (consignment, document, line number) once, the first that arrives, however late a copy or a line comes.

    Every key stays in the state for that. With a ``delay`` the state older than the watermark is dropped: a copy loaded
    later than that passes as first, and lines older than the watermark are left out.
    """
    keys = ["consignment_id", "source_doc", "line_no"]
    return lines.dropDuplicates(keys) if delay is None else lines.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(keys)


def arrivals(lines: DataFrame, window: str = "1 day", delay: str = "10 days") -> DataFrame:
    """Lines by document and window of load time, late ones included up to ``delay``."""
    counted = lines.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window), "source_doc")
    return counted.agg(F.count("*").alias("n_lines")).select(F.col("window.start").alias("start"), "source_doc", "n_lines")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint folder makes the next run go on from here, exactly once."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
