"""Cycles as they arrive: a file stream of frames, summed up for each cycle, and files rewritten for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def frame_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cycle_summary(frames: DataFrame) -> DataFrame:
    """Per run and cycle: number of walkers, sums and extremes of weight and progress. For tables and streams; state is a row for each cycle."""
    return frames.groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("n_walkers"), F.sum("weight").alias("total_weight"), F.min("progress").alias("least_progress"), F.max("progress").alias("most_progress"))


def run_dashboard(frames: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rewrite the table at ``out`` with the summary of all cycles after each micro-batch, until what there is has been read."""

    def rewrite(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return cycle_summary(frames).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(rewrite).start()


def event_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums in windows of event time; rows later than ``late`` behind the newest are not waited for."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
