"""Index jobs as a stream: the lease rules of the batch replay, kept as state per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.jobs import replay_stream

EVENTS = "job_id long, seq long, kind string, at double"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Job events that arrive as Parquet files in a folder, ``files`` to a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def start(events: DataFrame, target: str, checkpoint: str):
    """Writes each event's outcome; delivery is at least once, rows are keyed by (job_id, seq), and a restart goes on from the checkpoint."""

    def save(batch: DataFrame, number: int) -> None:
        # a repeated batch replaces its own folder, so it is there once
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return replay_stream(events).writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
