"""Windows and features that follow a live stream.

Every micro-batch writes one folder per table, named by its batch id; a batch
that is replayed after a failure overwrites its own folder and reads only those
of earlier batches, so results are exactly-once.  The state is in those shared
tables, not in one task, and no key's rows meet in one place: a batch adds up
its own rows and joins the sums with what is known of the same bins.

tumbling_windows: counts per window and channel.  A window closes, and is given
out once, when the newest time of the stream is ``delay`` past its end; rows that
come for a closed window go to a side table, so none is lost.

live_gold: rate and synchrony after every batch.  Synchrony needs the mean and
the standard deviation of the bins' totals; a batch retracts the square of a
bin's old total and adds that of the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlake.operators.store import bin_index
from eventlake.streaming.landing import WINDOW_MS

_COUNTS = "window_start_ms bigint, channel int, n bigint"
_LATE = "window_start_ms bigint, channel int, t bigint"
_CHANNELS = "stream_id string, channel int, n bigint, newest bigint"
_BINS = "stream_id string, bin bigint, n bigint"
_MOMENTS = "stream_id string, bins bigint, total bigint, squares decimal(38,0)"


def _prepare(spark: SparkSession, path: str, **tables: str) -> None:
    """An empty folder of every table, so that the first batch can read them."""
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/batch_id=-1")


def _put(df: DataFrame, path: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")


def _read(spark: SparkSession, path: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    out = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{path}/{name}")
    return out if before is None else out.where(F.col("batch_id") < before)


def _run(stream: DataFrame, checkpoint: str, write_batch) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def tumbling_windows(events: DataFrame, path: str, checkpoint: str, delay: int, width: int = WINDOW_MS) -> StreamingQuery:
    """Start counting (channel, t) events in windows of ``width``.

    Tables under ``path``: ``closed`` (each window once, when it closes),
    ``late`` (rows for closed windows) and ``counts`` (all others, by batch).
    Rows without a time are left out.
    """
    spark = events.sparkSession
    _prepare(spark, path, counts=_COUNTS, late=_LATE, closed=_COUNTS, newest="newest bigint")
    start = (F.floor(F.col("t") / F.lit(width)) * F.lit(width)).cast("bigint")

    def write_batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        rows = df.where("t IS NOT NULL").select("t", F.col("channel").cast("int").alias("channel")).withColumn("window_start_ms", start)
        seen = _read(session, path, "newest", "newest bigint", batch_id).agg(F.max("newest")).first()[0]
        now = rows.agg(F.max("t")).first()[0]
        now = max([x for x in (seen, now) if x is not None], default=None)
        over = lambda mark: F.lit(False) if mark is None else F.col("window_start_ms") + F.lit(width + delay) <= F.lit(mark)
        _put(rows.where(over(seen)).select("window_start_ms", "channel", "t"), path, "late", batch_id)
        _put(rows.where(~over(seen)).groupBy("window_start_ms", "channel").agg(F.count(F.lit(1)).alias("n")), path, "counts", batch_id)
        closing = _read(session, path, "counts", _COUNTS, batch_id + 1).where(over(now) & ~over(seen))
        _put(closing.groupBy("window_start_ms", "channel").agg(F.sum("n").alias("n")), path, "closed", batch_id)
        _put(session.createDataFrame([(now,)], "newest bigint"), path, "newest", batch_id)

    return _run(events, checkpoint, write_batch)


def windows_view(spark: SparkSession, path: str, width: int = WINDOW_MS) -> DataFrame:
    """(window_start_ms, channel, n, late, closed): all windows so far, late rows apart."""
    closed = _read(spark, path, "closed", _COUNTS).select("window_start_ms", "channel", "n", F.lit(True).alias("closed"))
    done = closed.select("window_start_ms").distinct()
    still = (_read(spark, path, "counts", _COUNTS).join(done, "window_start_ms", "left_anti")
             .groupBy("window_start_ms", "channel").agg(F.sum("n").alias("n")).withColumn("closed", F.lit(False)))
    late = _read(spark, path, "late", _LATE).groupBy("window_start_ms", "channel").agg(F.count(F.lit(1)).alias("late"))
    both = closed.unionByName(still).withColumn("late", F.lit(0).cast("bigint")).unionByName(
        late.select("window_start_ms", "channel", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("closed"), "late"))
    return both.groupBy("window_start_ms", "channel").agg(F.sum("n").alias("n"), F.sum("late").alias("late"), F.max("closed").alias("closed"))


def live_gold(events: DataFrame, window: int, path: str, checkpoint: str) -> StreamingQuery:
    """Start keeping Gold of (stream_id, channel, t) events; read it with
    :func:`gold_view` after any batch."""
    spark = events.sparkSession
    _prepare(spark, path, channels=_CHANNELS, bins=_BINS, moments=_MOMENTS)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        rows = df.select("stream_id", F.col("channel").cast("int").alias("channel"), "t")
        _put(rows.groupBy("stream_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("newest")), path, "channels", batch_id)
        _put(rows.groupBy("stream_id", bin_index("t", window).alias("bin")).agg(F.count(F.lit(1)).alias("n")), path, "bins", batch_id)
        new = session.read.schema(_BINS).parquet(f"{path}/bins/batch_id={batch_id}").select("stream_id", "bin", F.col("n").alias("added"))
        old = _read(session, path, "bins", _BINS, batch_id).join(new, ["stream_id", "bin"], "left_semi").groupBy("stream_id", "bin").agg(F.sum("n").alias("old"))
        wide = lambda c: F.col(c).cast("decimal(18,0)") * F.col(c).cast("decimal(18,0)")
        moved = (new.join(old, ["stream_id", "bin"], "left").withColumn("before", F.coalesce("old", F.lit(0)))
                 .withColumn("after", F.col("before") + F.col("added")))
        _put(moved.groupBy("stream_id").agg(F.count_if(F.col("old").isNull()).alias("bins"), F.sum("added").alias("total"),
                                            F.sum(wide("after") - wide("before")).cast("decimal(38,0)").alias("squares")), path, "moments", batch_id)

    return _run(events, checkpoint, write_batch)


def gold_view(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Gold (stream_id, channel, count, rate, synchrony_cv) of all batches, or of those before one."""
    channels = _read(spark, path, "channels", _CHANNELS, before).groupBy("stream_id", "channel").agg(F.sum("n").alias("count"), F.max("newest").alias("newest"))
    span = channels.groupBy("stream_id").agg((F.max("newest") + F.lit(1)).cast("double").alias("duration"))
    m = _read(spark, path, "moments", _MOMENTS, before).groupBy("stream_id").agg(
        F.sum("bins").cast("double").alias("bins"), F.sum("total").cast("double").alias("total"), F.sum("squares").cast("double").alias("squares"))
    mean = F.col("total") / F.col("bins")
    spread = F.sqrt(F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0)) / F.greatest(F.col("bins") - F.lit(1.0), F.lit(1.0)))
    cv = m.select("stream_id", F.when((F.col("total") == 0) | (F.col("bins") < 2), F.lit(0.0)).otherwise(spread / mean).alias("synchrony_cv"))
    return channels.join(span, "stream_id").join(cv, "stream_id").select(
        "stream_id", "channel", "count", F.try_divide(F.col("count").cast("double"), F.col("duration")).alias("rate"), "synchrony_cv")
