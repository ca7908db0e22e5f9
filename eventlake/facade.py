"""Fluent entry point: ``EventLake(spark, events)``; every method returns a DataFrame
(``gate`` returns a small report dict or raises)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import medallion, patterns, quality, store
from eventlake.sources import lake


class EventLake:
    """Queries over an event table ``(stream_id, channel, t)`` (a DataFrame or a Parquet path)."""

    def __init__(self, spark: SparkSession, events: DataFrame | str):
        self.spark = spark
        self.path = events if isinstance(events, str) else None
        self.events = spark.read.parquet(events) if isinstance(events, str) else events

    # store
    def window(self, t0: int, t1: int, channels: Sequence[int] | None = None) -> DataFrame:
        return store.window_query(self.events, t0, t1, channels)

    def count(self) -> DataFrame:
        return store.event_count(self.events)

    def rates(self, duration: int | None = None, n_channels: int | None = None, include_silent: bool = False) -> DataFrame:
        return store.firing_rates(self.events, duration, n_channels, include_silent)

    def bins(self, window: int, duration: int | None = None) -> DataFrame:
        return store.dense_bins(self.events, window, duration)

    def bursts(self, window: int, k: int, duration: int | None = None) -> DataFrame:
        return store.bursts(self.events, window, k, duration)

    def isi(self) -> DataFrame:
        return store.isi(self.events)

    # medallion
    def silver(self, window: int) -> DataFrame:
        return medallion.silver(self.events, window)

    def gold(self, window: int, duration: int | None = None) -> DataFrame:
        return medallion.gold(self.events, self.silver(window), duration)

    def icr(self, window: int, duration: int | None = None, n_channels: int | None = None) -> DataFrame:
        return medallion.icr(self.silver(window), window, duration, n_channels)

    def handoff(self, window: int, t_steps: int = 32) -> DataFrame:
        return medallion.latency_handoff(self.gold(window), t_steps)

    # quality
    def fingerprint(self) -> DataFrame:
        return quality.fingerprint(self.events)

    def gate(self, n_channels: int, duration: int, window: int | None = None) -> dict:
        gold = self.gold(window) if window else None
        return quality.gate(self.events, n_channels, duration, gold=gold)

    # patterns
    def coincidence(self, channels: Sequence[int], window: int, k: int, detector: str = "subdetector") -> DataFrame:
        return patterns.coincidence(self.events, channels, window, k, detector=detector)

    def coincidence_raw(self, channels: Sequence[int], window: int, k: int) -> DataFrame:
        return patterns.coincidence_raw(self.events, channels, window, k)

    def sequence(self, ordered: Sequence[int], window: int) -> DataFrame:
        return patterns.sequence(self.events, ordered, window)

    def query_cost(self, channels: Sequence[int]) -> DataFrame:
        """Events a pattern over ``channels`` reads per stream and, over a Bronze path, its partitions, files and bytes."""
        read = patterns.pattern_stats(self.events, channels)
        if self.path is None:
            return read
        return lake.scan_stats(self.spark, self.path, channels).join(read, "stream_id", "left").withColumn("events_read", F.coalesce("events_read", F.lit(0)))
