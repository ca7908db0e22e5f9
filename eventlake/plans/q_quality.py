"""Quality-gate, fingerprint, band and multiset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.functions.timecols import ntz_literal
from eventlake.operators import medallion, quality, stats
from eventlake.plans.common import BIN, DAY, SPIKES_SQL, spikes
from eventlake.plans.q_ingest import JSON_SQL, json_df
from eventlake.plans.q_store import GOLD_SQL
from eventlake.plans.registry import query
from eventlake.sources import parse
from eventlake.sources.tables import table

DECL_CHANNELS = 128
DECL_DURATION = 28 * DAY
WITH = f"WITH spikes AS ({SPIKES_SQL})"


@query("schema_gate",
       f"{WITH} SELECT stream_id, channel, t, CASE WHEN t IS NULL OR channel IS NULL THEN 'null_field' "
       f"WHEN t < 0 OR t >= {DECL_DURATION} THEN 't_out_of_range' "
       f"WHEN channel < 0 OR channel >= {DECL_CHANNELS} THEN 'channel_out_of_range' END AS reason FROM spikes "
       f"WHERE t IS NULL OR channel IS NULL OR t < 0 OR t >= {DECL_DURATION} OR channel < 0 OR channel >= {DECL_CHANNELS}")
def q_schema_gate(spark, sf):
    return quality.schema_violations(spikes(spark, sf), DECL_CHANNELS, DECL_DURATION)


@query("encodable_gate",
       "SELECT count(*) AS rows, "
       "count(*) FILTER (WHERE NOT coalesce(TRY_CAST(TRY_CAST(l_extendedprice AS BIGINT) AS DOUBLE) = l_extendedprice, false)) AS bad_t, "
       "count(*) FILTER (WHERE NOT coalesce(TRY_CAST(TRY_CAST(l_quantity AS INTEGER) AS DOUBLE) = l_quantity, false)) AS bad_channel, "
       "count(*) FILTER (WHERE NOT coalesce(TRY_CAST(TRY_CAST(l_extendedprice AS BIGINT) AS DOUBLE) = l_extendedprice, false)) = 0 "
       "AND count(*) FILTER (WHERE NOT coalesce(TRY_CAST(TRY_CAST(l_quantity AS INTEGER) AS DOUBLE) = l_quantity, false)) = 0 "
       "AS passed FROM lineitem")
def q_encodable(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("t"), F.col("l_quantity").alias("channel"))
    return quality.encodable_report(li)


@query("gold_gate",
       f"{WITH} SELECT stream_id, count(*) AS n_channels, "
       "bool_and(rate IS NOT NULL AND NOT isnan(rate) AND rate <> 'inf'::DOUBLE AND rate >= 0) AS rates_ok, "
       "bool_and(synchrony_cv IS NOT NULL AND NOT isnan(synchrony_cv) AND synchrony_cv <> 'inf'::DOUBLE "
       "AND synchrony_cv >= 0) AS synchrony_ok, "
       "bool_and(rate IS NOT NULL AND NOT isnan(rate) AND rate <> 'inf'::DOUBLE AND rate >= 0) AND "
       "bool_and(synchrony_cv IS NOT NULL AND NOT isnan(synchrony_cv) AND synchrony_cv <> 'inf'::DOUBLE "
       f"AND synchrony_cv >= 0) AS passed FROM ({GOLD_SQL}) GROUP BY stream_id")
def q_gold_gate(spark, sf):
    b = spikes(spark, sf)
    return quality.gold_report(medallion.gold(b, medallion.silver(b, BIN)))


@query("gold_gate_icr",
       f"{WITH}, icr AS (SELECT stream_id, (max(channel) + 1) * (max(t) // {BIN} + 1) AS raw FROM spikes GROUP BY stream_id) "
       "SELECT g.stream_id, count(*) AS n_channels, bool_and(rate >= 0 AND isfinite(rate)) AS rates_ok, "
       "bool_and(synchrony_cv >= 0 AND isfinite(synchrony_cv)) AS synchrony_ok, bool_and(raw > 0) AS icr_ok, "
       "bool_and(rate >= 0 AND isfinite(rate) AND synchrony_cv >= 0 AND isfinite(synchrony_cv) AND raw > 0) AS passed "
       f"FROM ({GOLD_SQL}) g JOIN icr USING (stream_id) GROUP BY g.stream_id",
       note="the gate with the inverse compression ratio; SQL knows the raster's size, not its gzip length")
def q_gold_gate_icr(spark, sf):
    b = spikes(spark, sf)
    silver = medallion.silver(b, BIN)
    return quality.gold_report(medallion.gold(b, silver), medallion.icr(silver, BIN))


@query("bronze_fingerprint",
       f"{WITH}, h AS (SELECT stream_id, CAST(('0x' || substr(md5(concat_ws(':', stream_id, CAST(channel AS VARCHAR), "
       "CAST(t AS VARCHAR))), 1, 15)) AS BIGINT) AS h FROM spikes), "
       "a AS (SELECT stream_id, count(*) AS n_rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum FROM h GROUP BY ALL) "
       "SELECT stream_id, n_rows, hash_sum, sha256(CAST(n_rows AS VARCHAR) || ':' || hash_sum) AS fingerprint FROM a")
def q_fingerprint(spark, sf):
    return quality.fingerprint(spikes(spark, sf))


BAND_RUNS = "SELECT l_returnflag AS metric, l_discount AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'"
BAND_NEW = "SELECT l_returnflag AS metric, l_discount AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'"
BAND_K = 2.0
BAND_SQL = (f"SELECT metric, count(*) AS n, avg(value) AS mean, CASE WHEN count(*) = 1 THEN 0.0 "
            f"ELSE coalesce(stddev_samp(value), 0.0) END AS std FROM ({BAND_RUNS}) GROUP BY metric")


def _runs(spark, sf, new=False):
    li = table(spark, sf, "lineitem")
    cond = F.col("l_shipdate") >= ntz_literal("1999-01-01 00:00:00")
    return li.filter(cond if new else ~cond).select(F.col("l_returnflag").alias("metric"),
                                                   F.col("l_discount").alias("value"))


@query("stat_band",
       f"SELECT metric, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - {BAND_K} * std, 6) AS lo, "
       f"round(mean + {BAND_K} * std, 6) AS hi FROM ({BAND_SQL})")
def q_stat_band(spark, sf):
    b = stats.stat_band(_runs(spark, sf), k=BAND_K)
    return b.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")])


@query("band_check",
       f"SELECT n.metric, count(*) AS n_new, count(*) FILTER (WHERE n.value >= b.mean - {BAND_K} * b.std "
       f"AND n.value <= b.mean + {BAND_K} * b.std) AS n_within, count(*) FILTER (WHERE n.value >= 0.02 "
       f"AND n.value < b.mean - {BAND_K} * b.std) AS floor_misses FROM ({BAND_NEW}) n JOIN ({BAND_SQL}) b USING (metric) "
       "GROUP BY n.metric")
def q_band_check(spark, sf):
    chk = stats.band_check(_runs(spark, sf, new=True), stats.stat_band(_runs(spark, sf), k=BAND_K), floor=0.02)
    return chk.groupBy("metric").agg(F.count(F.lit(1)).alias("n_new"), F.count_if("within").alias("n_within"),
                                     F.count_if("floor_misses").alias("floor_misses"))


@query("multiset_equal",
       f"{WITH}, a AS (SELECT t, channel FROM spikes), "
       f"b AS (SELECT t, channel FROM (SELECT CASE WHEN json_valid(line) THEN TRY_CAST(json_extract(line, '$.t') AS BIGINT) END AS t, "
       "CASE WHEN json_valid(line) THEN TRY_CAST(json_extract(line, '$.channel') AS INTEGER) END AS channel, "
       "CASE WHEN json_valid(line) THEN json_type(line, '$.t') END AS tt "
       f"FROM ({JSON_SQL})) WHERE tt IN ('BIGINT', 'UBIGINT') AND t IS NOT NULL AND channel IS NOT NULL), "
       "d AS (SELECT t, channel, sum(s) AS d FROM (SELECT t, channel, 1 AS s FROM a UNION ALL "
       "SELECT t, channel, -1 AS s FROM b) GROUP BY ALL) "
       "SELECT CAST(coalesce(sum(d) FILTER (WHERE d > 0), 0) AS BIGINT) AS missing, "
       "CAST(coalesce(sum(-d) FILTER (WHERE d < 0), 0) AS BIGINT) AS extra, "
       "coalesce(sum(d) FILTER (WHERE d > 0), 0) = 0 AND coalesce(sum(-d) FILTER (WHERE d < 0), 0) = 0 AS equal FROM d")
def q_multiset(spark, sf):
    a = spikes(spark, sf).select("t", "channel")
    b = parse.json_events(json_df(spark, sf)).select("t", "channel")
    return stats.multiset_diff(a, b, ["t", "channel"])
