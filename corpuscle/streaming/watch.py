"""Continuous views over change streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE = "500 milliseconds"


def read_changes(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of change records from Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The latest operation on each path, kept up to date (update or complete mode)."""
    return changes.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply each batch of changes, the last of each path only, as an upsert; ``once`` drains what is there and ends."""

    def batch(df: DataFrame, number: int) -> None:
        apply(df.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op")), number)

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=DEBOUNCE)).start()
