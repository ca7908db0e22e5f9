"""Store, medallion and aggregate queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.operators import medallion, store
from eventlake.plans.common import (BIN, BURST_K, DAY, SPIKES_SQL, T_STEPS, WQ_CH_T0, WQ_CH_T1, WQ_CHANNELS,
                                    WQ_T0, WQ_T1, spikes)
from eventlake.plans.registry import query

W = BIN
WITH = f"WITH spikes AS ({SPIKES_SQL})"
SILVER_SQL = f"SELECT stream_id, channel, CAST(floor(t / {W}.0) AS BIGINT) AS bin, count(*) AS spikes FROM spikes GROUP BY ALL"
RATE_SQL = ("SELECT c.stream_id, c.channel, c.cnt AS \"count\", c.cnt / CAST(b.dur AS DOUBLE) AS rate "
            "FROM (SELECT stream_id, channel, count(*) AS cnt FROM spikes GROUP BY ALL) c "
            "JOIN (SELECT stream_id, max(t) + 1 AS dur FROM spikes GROUP BY ALL) b USING (stream_id)")
SYNC_SQL = ("SELECT stream_id, round(CASE WHEN coalesce(avg(pop), 0) = 0 THEN 0.0 "
            "ELSE coalesce(stddev_samp(pop) / avg(pop), 0.0) END, 6) AS synchrony_cv "
            f"FROM (SELECT stream_id, bin, sum(spikes) AS pop FROM ({SILVER_SQL}) GROUP BY ALL) GROUP BY stream_id")
GOLD_SQL = (f"SELECT r.stream_id, r.channel, r.\"count\", r.rate, s.synchrony_cv FROM ({RATE_SQL}) r "
            f"JOIN ({SYNC_SQL}) s USING (stream_id)")


def _gold(spark, sf):
    b = spikes(spark, sf)
    g = medallion.gold(b, medallion.silver(b, W))
    return g.withColumn("synchrony_cv", F.round("synchrony_cv", 6))


@query("window_query", f"{WITH} SELECT stream_id, channel, t FROM spikes WHERE t >= {WQ_T0} AND t < {WQ_T1}")
def q_window_query(spark, sf):
    return store.window_query(spikes(spark, sf, t0=WQ_T0, t1=WQ_T1), WQ_T0, WQ_T1)


@query("window_query_channels",
       f"{WITH} SELECT stream_id, channel, t FROM spikes WHERE t >= {WQ_CH_T0} AND t < {WQ_CH_T1} "
       f"AND channel IN ({', '.join(map(str, WQ_CHANNELS))})")
def q_window_query_channels(spark, sf):
    src = spikes(spark, sf, t0=WQ_CH_T0, t1=WQ_CH_T1, channels=WQ_CHANNELS)
    return store.window_query(src, WQ_CH_T0, WQ_CH_T1, WQ_CHANNELS)


@query("silver_counts", f"{WITH} {SILVER_SQL}")
def q_silver(spark, sf):
    return medallion.silver(spikes(spark, sf), W)


@query("dense_bins",
       f"{WITH}, b AS (SELECT stream_id, max(channel) + 1 AS n, max(t) + 1 AS dur FROM spikes GROUP BY ALL), "
       f"sil AS ({SILVER_SQL}), "
       "ch AS (SELECT stream_id, dur, CAST(unnest(range(0, n)) AS INTEGER) AS channel FROM b), "
       f"spine AS (SELECT stream_id, channel, unnest(range(0, (dur + {W - 1}) // {W})) AS bin FROM ch) "
       "SELECT s.stream_id, s.channel, s.bin, coalesce(x.spikes, 0) AS spikes "
       "FROM spine s LEFT JOIN sil x USING (stream_id, channel, bin)")
def q_dense_bins(spark, sf):
    return store.dense_bins(spikes(spark, sf), W)


@query("firing_rate", f"{WITH} {RATE_SQL}")
def q_firing_rate(spark, sf):
    return store.firing_rates(spikes(spark, sf))


@query("synchrony", f"{WITH} {SYNC_SQL}")
def q_synchrony(spark, sf):
    b = spikes(spark, sf)
    return medallion.synchrony(medallion.silver(b, W)).withColumn("synchrony_cv", F.round("synchrony_cv", 6))


@query("gold_features", f"{WITH} {GOLD_SQL}")
def q_gold(spark, sf):
    return _gold(spark, sf)


@query("top_channels", f"{WITH} SELECT stream_id, channel, \"count\", rate FROM ({GOLD_SQL}) "
       "ORDER BY rate DESC, stream_id, channel LIMIT 5")
def q_top_channels(spark, sf):
    return store.top_by_rate_sql(_gold(spark, sf), 5)


@query("busiest_channels", f"{WITH} SELECT stream_id, channel, count(*) AS total FROM spikes GROUP BY ALL "
       "ORDER BY total DESC, stream_id, channel LIMIT 3")
def q_busiest(spark, sf):
    return store.top_channels_by_total(spikes(spark, sf), 3)


@query("isi", f"{WITH} SELECT * FROM (SELECT stream_id, channel, t, "
       "t - lag(t) OVER (PARTITION BY stream_id, channel ORDER BY t) AS isi FROM spikes) WHERE isi IS NOT NULL")
def q_isi(spark, sf):
    return store.isi(spikes(spark, sf), block=DAY)


@query("bursts", f"{WITH} SELECT stream_id, channel, CAST(floor(t / {DAY}.0) AS BIGINT) * {DAY} AS bin_start, "
       f"count(*) AS spikes FROM spikes GROUP BY stream_id, channel, CAST(floor(t / {DAY}.0) AS BIGINT) "
       f"HAVING count(*) >= {BURST_K}")
def q_bursts(spark, sf):
    return store.bursts(spikes(spark, sf), DAY, BURST_K)


@query("event_count", f"{WITH} SELECT stream_id, count(*) AS n_events FROM spikes GROUP BY ALL")
def q_event_count(spark, sf):
    return store.event_count(spikes(spark, sf))


@query("storage_report",
       f"{WITH} SELECT stream_id, count(*) AS n_events, CAST(max(channel) + 1 AS INTEGER) AS n_channels, "
       "max(t) + 1 AS duration, 12 + 12 * (max(channel) + 1) + 4 * count(*) AS sparse_bytes, "
       "8 * count(*) AS log_bytes, "
       "CAST(((max(channel) + 1) * (max(t) + 1) + 7) // 8 AS BIGINT) AS raster_1bit_bytes, "
       "CAST((max(channel) + 1) * (max(t) + 1) AS BIGINT) AS raster_1byte_bytes FROM spikes GROUP BY ALL")
def q_storage(spark, sf):
    return store.storage_report(spikes(spark, sf))


@query("latency_handoff",
       f"{WITH}, g AS ({RATE_SQL}), m AS (SELECT stream_id, CASE WHEN max(rate) = 0 THEN 1.0 ELSE max(rate) END AS mx "
       "FROM g GROUP BY ALL) SELECT g.stream_id, "
       f"CAST(round_even((1.0 - g.rate / m.mx) * {T_STEPS - 1}, 0) AS INTEGER) AS t, g.channel "
       "FROM g JOIN m USING (stream_id) WHERE g.rate / m.mx > 0.1")
def q_handoff(spark, sf):
    b = spikes(spark, sf)
    return medallion.latency_handoff(store.firing_rates(b), T_STEPS)


@query("icr_blocks", None, note="gzip length is not SQL-expressible")
def q_icr_blocks(spark, sf):
    b = spikes(spark, sf)
    return medallion.icr_blocks(medallion.silver(b, W), W, bins_per_block=24 * 7)


@query("icr", None, note="gzip length of a stream's whole raster is not SQL-expressible")
def q_icr(spark, sf):
    return medallion.icr(medallion.silver(spikes(spark, sf), W), W)
