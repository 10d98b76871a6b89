"""Resumable stages: a file source with a checkpoint takes each new file once and appends its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_available(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000
) -> None:
    """Processes the files that came since the last call, then stops. A broken run resumes where it was."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    done = stage(new).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    done.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def parse_available(spark: SparkSession, source: str, target: str, checkpoint: str, pattern: str = "*.rdf") -> None:
    """The same for record files."""
    from ..sources.records import parse_records

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    new = files.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    done = parse_records(new).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    done.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by time window and type; rows later than `late` are dropped once their window is closed."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
