"""Shared parameters and SQL fragments of the query catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.functions.timecols import SQL_T_MS
from eventlake.sources import adapters
from eventlake.sources.tables import table

# Fixed query parameters (time in ms of the event table).
HOUR = 3_600_000
DAY = 24 * HOUR
BIN = HOUR                 # Silver bin width
WQ_T0, WQ_T1 = 5 * DAY, 6 * DAY
WQ_CHANNELS = [7, 42, 99]
WQ_CH_T0, WQ_CH_T1 = 2 * DAY, 20 * DAY
BURST_K = 3
COINC_CHANNELS = [7, 42, 99]
COINC_W = 6 * HOUR
COINC_K = 2
SEQ_ORDER = [4, 0, 2]      # view -> click -> purchase
SEQ_REVERSE = [2, 0, 4]
SEQ_W = 6 * HOUR
T_STEPS = 32
N_FEATURES = 64
FLOOR = 0.10
TAU = 4.0

SPIKES_SQL = (f"SELECT 'events' AS stream_id, CAST(user_id AS INTEGER) AS channel, {SQL_T_MS} AS t "
              "FROM events")
TYPE_CASE = ("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
             "WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END")
SPIKES_BY_TYPE_SQL = (f"SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST({TYPE_CASE} AS INTEGER) AS channel, "
                      f"{SQL_T_MS} AS t FROM events")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def spikes(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return adapters.spikes_by_user(events(spark, sf), **kw)


def spikes_by_type(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return adapters.spikes_by_type(events(spark, sf), **kw)
