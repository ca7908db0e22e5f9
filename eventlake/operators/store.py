"""Telemetry-store queries over the event table (stream_id, channel, t)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.ordered import DEFAULT_BLOCK, prev_value

CHANNELS_AT_ONCE, BINS_AT_ONCE = 1024, 1024      # parts of the dense grid; no result depends on them


def check_channels(channels: Sequence[int] | None, n_channels: int | None = None) -> list[int] | None:
    """Validate a channel list eagerly (negative ids never index from the end)."""
    if channels is None:
        return None
    out = sorted({int(c) for c in channels})
    for c in out:
        if c < 0 or (n_channels is not None and c >= n_channels):
            raise IndexError(f"channel {c} out of range")
    return out


def window_query(events: DataFrame, t0: int, t1: int, channels: Sequence[int] | None = None) -> DataFrame:
    """Events with ``t0 <= t < t1`` (half-open), optionally on a channel list."""
    chans = check_channels(channels)
    out = events.filter((F.col("t") >= F.lit(int(t0))) & (F.col("t") < F.lit(int(t1))))
    if chans is not None:
        out = out.filter(F.col("channel").isin(chans))
    return out


def stream_bounds(events: DataFrame, n_channels: int | None = None, duration: int | None = None) -> DataFrame:
    """One row per stream: declared bounds, or ``max(channel)+1`` / ``max(t)+1``."""
    return events.groupBy("stream_id").agg(
        (F.lit(int(n_channels)) if n_channels is not None else (F.max("channel") + 1)).cast("int").alias("n_channels"),
        (F.lit(int(duration)) if duration is not None else (F.max("t") + 1)).cast("bigint").alias("duration"),
    )


def event_count(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_events"))


def channel_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id", "channel").agg(F.count(F.lit(1)).alias("count"))


def firing_rates(events: DataFrame, duration: int | None = None, n_channels: int | None = None,
                 include_silent: bool = False) -> DataFrame:
    """count / duration per channel.  ``duration=None`` uses ``max(t)+1`` per stream.

    ``include_silent`` adds the channels of ``[0, n_channels)`` without events
    with rate 0 (the in-memory store's behaviour); Gold drops them.
    """
    counts = channel_counts(events)
    bounds = stream_bounds(events, n_channels, duration)
    if include_silent:
        spine = bounds.select("stream_id", F.explode(F.sequence(F.lit(0), F.col("n_channels") - 1)).alias("channel"))
        counts = (spine.join(counts, ["stream_id", "channel"], "left")
                  .select("stream_id", "channel", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
    return (counts.join(bounds, "stream_id")
            .select("stream_id", "channel", "count",
                    (F.col("count") / F.col("duration").cast("double")).alias("rate")))


def bin_index(t: str, window: int):
    """Python floor division semantics (negative t floors, SURVEY trap 8)."""
    return F.floor(F.col(t) / F.lit(int(window))).cast("bigint")


def silver_counts(events: DataFrame, window: int) -> DataFrame:
    """Non-empty bins: (stream_id, channel, bin, spikes)."""
    return (events.groupBy("stream_id", "channel", bin_index("t", window).alias("bin"))
            .agg(F.count(F.lit(1)).alias("spikes")))


def dense_bins(events: DataFrame, window: int, duration: int | None = None,
               n_channels: int | None = None, channels: Sequence[int] | None = None) -> DataFrame:
    """Every bin ``0..ceil(duration/W)-1`` of every channel, zeros included.

    A channel's bins are cut into blocks.  Each block has a row before its first
    bin; that row and every count bring the zeros up to the next count, so the
    shuffle holds the counts and a row per block, never the whole grid.
    """
    silver = silver_counts(events, window).filter(F.col("stream_id").isNotNull())
    bounds = stream_bounds(events, n_channels, duration)
    nb = F.floor((F.col("duration") + F.lit(int(window) - 1)) / F.lit(int(window))).cast("bigint")
    some = (bounds.select("stream_id", "n_channels", nb.alias("nb")).filter("n_channels > 0 AND nb > 0")
            .select("stream_id", "n_channels", "nb", F.explode(F.sequence(F.lit(0), F.col("n_channels") - 1, F.lit(CHANNELS_AT_ONCE))).alias("c0"))
            .repartition("stream_id", "c0"))
    last = F.least(F.col("n_channels").cast("bigint"), F.col("c0").cast("bigint") + CHANNELS_AT_ONCE) - 1
    spine = some.select("stream_id", "nb", F.explode(F.sequence(F.col("c0").cast("bigint"), last)).alias("channel"))
    chans = check_channels(channels)
    if chans is not None:
        spine, silver = spine.filter(F.col("channel").isin(chans)), silver.filter(F.col("channel").isin(chans))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1, F.lit(BINS_AT_ONCE).cast("bigint")))
    blocks = (spine.select("stream_id", "channel", "nb", first.alias("start"))
              .select("stream_id", "channel", F.floor(F.col("start") / BINS_AT_ONCE).cast("bigint").alias("block"), (F.col("start") - 1).alias("bin"),
                      F.lit(0).cast("bigint").alias("spikes"), F.least("nb", F.col("start") + BINS_AT_ONCE).alias("end")))
    counts = silver.select("stream_id", F.col("channel").cast("bigint").alias("channel"), F.floor(F.col("bin") / BINS_AT_ONCE).cast("bigint").alias("block"),
                           "bin", "spikes", F.lit(None).cast("bigint").alias("end"))
    block = Window.partitionBy("stream_id", "channel", "block")
    runs = (blocks.unionByName(counts).withColumn("end", F.max("end").over(block))       # none: outside the bounds
            .filter(F.col("bin") < F.col("end"))
            .withColumn("next", F.coalesce(F.lead("bin").over(block.orderBy("bin")), F.col("end")))
            .withColumn("from", F.greatest("bin", F.col("block") * BINS_AT_ONCE)).filter(F.col("from") < F.col("next")))
    own, n = F.col("bin"), F.col("spikes")
    return (runs.select("stream_id", "channel", own.alias("own"), n.alias("n"), F.explode(F.sequence("from", F.col("next") - 1)).alias("bin"))
            .select("stream_id", F.col("channel").cast("int").alias("channel"), "bin",
                    F.when(F.col("bin") == F.col("own"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("spikes")))


def bursts(events: DataFrame, window: int, k: int, duration: int | None = None) -> DataFrame:
    """Bins with ``spikes >= k`` as (stream_id, channel, bin_start, spikes).

    With ``k <= 0`` every bin qualifies, empty ones included (dense bins).
    """
    bins = dense_bins(events, window, duration) if k <= 0 else silver_counts(events, window)
    return (bins.filter(F.col("spikes") >= F.lit(int(k)))
            .select("stream_id", "channel", (F.col("bin") * F.lit(int(window))).alias("bin_start"), "spikes"))


def isi(events: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Inter-spike intervals per (stream, channel): ``t - previous t``.

    Computed per time block with a carried previous value, so a channel that
    holds most rows is still spread over many tasks.
    """
    d = prev_value(events.select("stream_id", "channel", "t"), ["stream_id", "channel"], "t", block)
    return (d.filter(F.col("prev_t").isNotNull())
            .select("stream_id", "channel", "t", (F.col("t") - F.col("prev_t")).alias("isi")))


def top_channels_by_total(events: DataFrame, k: int = 3) -> DataFrame:
    """Column-pruned scan -> per-channel totals -> top k (ties: smaller channel)."""
    return (channel_counts(events).orderBy(F.col("count").desc(), F.col("stream_id"), F.col("channel"))
            .limit(int(k)).withColumnRenamed("count", "total"))


def top_by_rate_sql(gold: DataFrame, k: int = 5) -> DataFrame:
    """SQL over Gold through a temp view: top ``k`` channels by rate."""
    spark = gold.sparkSession
    gold.createOrReplaceTempView("gold_features")
    return spark.sql(
        "SELECT stream_id, channel, count, rate FROM gold_features "
        f"ORDER BY rate DESC, stream_id, channel LIMIT {int(k)}")


def storage_report(events: DataFrame, n_channels: int | None = None, duration: int | None = None) -> DataFrame:
    """Sparse event bytes vs dense 1-bit / 1-byte rasters per stream.

    Sparse layout: 12-byte header, 12-byte index entry per channel, 4 bytes
    per event time; append log: 8 bytes per event.
    """
    stats = event_count(events).join(stream_bounds(events, n_channels, duration), "stream_id")
    raster_cells = F.col("n_channels").cast("bigint") * F.col("duration")
    return stats.select(
        "stream_id", "n_events", "n_channels", "duration",
        (F.lit(12) + F.lit(12) * F.col("n_channels") + F.lit(4) * F.col("n_events")).cast("bigint").alias("sparse_bytes"),
        (F.lit(8) * F.col("n_events")).cast("bigint").alias("log_bytes"),
        F.floor((raster_cells + F.lit(7)) / F.lit(8)).cast("bigint").alias("raster_1bit_bytes"),
        raster_cells.alias("raster_1byte_bytes"),
    )
