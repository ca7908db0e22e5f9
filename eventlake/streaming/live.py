"""Record-while-query store and live Silver.

record(): append the event stream to a Parquet path with a checkpoint — the
file sink's commit log makes each micro-batch visible atomically and
exactly once; queries read the same path in batch (C1 etc.).  Restarting
with the same checkpoint resumes without duplicates (J2).  Arrival order
does not matter: queries order by (t, channel) at read time (J3).

live_silver(): per micro-batch partial counts per (stream, channel, bin)
appended as deltas; :func:`silver_view` sums the deltas on read, so late
or out-of-order events simply add to their bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlake.operators.store import bin_index


def record(events: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ("stream_id",),
           available_now: bool = True) -> StreamingQuery:
    w = (events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy(*partition_by).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Batch view of everything committed so far (reads the sink's log)."""
    return spark.read.parquet(path)


def live_silver(events: DataFrame, window: int, path: str, checkpoint: str) -> StreamingQuery:
    def write_batch(df: DataFrame, batch_id: int) -> None:
        part = (df.groupBy("stream_id", "channel", bin_index("t", window).alias("bin"))
                .agg(F.count(F.lit(1)).alias("spikes")))
        part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def silver_view(spark: SparkSession, path: str) -> DataFrame:
    deltas = spark.read.parquet(path)
    return deltas.groupBy("stream_id", "channel", "bin").agg(F.sum("spikes").alias("spikes"))
