"""Job states from a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopyframe.operators.jobs import latest_status

EVENT_SCHEMA = "event_id bigint, job_id bigint, ts timestamp, status string, params string"


def read_events(spark: SparkSession, landing: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(landing)


def stream_status(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed job states of every batch as ``sink/batch=<id>``.

    The newest batch that holds a job has its current state.
    """
    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (latest_status(events).writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    """Latest state of each job over all written batches."""
    rows = spark.read.parquet(sink)
    fields = ("created", "updated", "status", "params")
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("job_id", "s.*")
