"""Streaming landing.

publish_json: events -> JSON messages (Kafka in production, JSON text files
here).  land: messages -> from_json (PERMISSIVE) -> valid rows appended to
Parquet partitioned by the 60-second window start; malformed messages go to
a dead-letter table in the same micro-batch (foreachBatch, idempotent per
batch id via partition overwrite of that batch's folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlake.functions.timecols import EVENT_EPOCH
from eventlake.schema import JSON_EVENT

WINDOW = "60 seconds"
WINDOW_MS = 60_000


def publish_json(stream: DataFrame, out_path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Write (line_id, line) messages as JSON text files (the message bus)."""
    w = (stream.select(F.to_json(F.struct("line_id", "line")).alias("value"))
         .writeStream.format("text").option("path", out_path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="5 seconds")
    return w.start()


def parse_messages(messages: DataFrame) -> DataFrame:
    """value (JSON envelope) -> line_id, line, parsed event struct."""
    env = messages.select(F.from_json("value", "line_id long, line string").alias("m"))
    return env.select("m.line_id", "m.line", F.from_json("m.line", JSON_EVENT, {"mode": "PERMISSIVE"}).alias("e"))


def land(messages: DataFrame, out_path: str, dead_path: str, checkpoint: str,
         epoch: str = EVENT_EPOCH) -> StreamingQuery:
    """Valid events -> Parquet with ``window_start_ms`` (60 s tumbling windows
    of event time), partitioned by day; malformed -> dead letters."""
    parsed = parse_messages(messages)
    ok = F.col("e.t").isNotNull() & F.col("e.channel").isNotNull()

    def write_batch(df: DataFrame, batch_id: int) -> None:
        good = df.filter(ok).select("line_id", F.col("e.t").alias("t"), F.col("e.channel").alias("channel"))
        good = good.withColumn("window_start_ms", (F.floor(F.col("t") / F.lit(WINDOW_MS)) * F.lit(WINDOW_MS)).cast("bigint"))
        good = good.withColumn("window_day", F.floor(F.col("t") / F.lit(86_400_000)).cast("bigint"))
        # one folder per batch id: a replayed batch overwrites its own output
        # (exactly-once); day partitions keep files large, the 60 s window is a column
        (good.write.mode("overwrite").partitionBy("window_day")
         .parquet(f"{out_path}/batch_id={batch_id}"))
        (df.filter(~ok).select("line_id", "line", F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}"))

    return (parsed.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_landed(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path)
