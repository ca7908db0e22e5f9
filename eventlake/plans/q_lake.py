"""Pipeline and lake-layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.facade import EventLake
from eventlake.operators import match, pipeline
from eventlake.plans.common import BIN, SPIKES_SQL, WQ_CH_T0, WQ_CH_T1, WQ_CHANNELS, spikes
from eventlake.plans.q_signals import NORM_SQL, PROTO_SQL, SPLIT_SQL, _norm, _split
from eventlake.plans.q_store import GOLD_SQL
from eventlake.plans.registry import query
from eventlake.sources import lake
from eventlake.streaming.common import run_dir


@query("medallion_pipeline", f"WITH spikes AS ({SPIKES_SQL}) {GOLD_SQL}")
def q_medallion(spark, sf):
    out = run_dir(spark, "medallion")
    res = pipeline.run_medallion(spark, spikes(spark, sf), out, BIN)
    g = spark.read.parquet(res.gold)
    return g.select("stream_id", "channel", "count", "rate", F.round("synchrony_cv", 6).alias("synchrony_cv"))


@query("partial_read",
       f"WITH spikes AS ({SPIKES_SQL}) SELECT stream_id, channel, t FROM spikes WHERE t >= {WQ_CH_T0} AND t < {WQ_CH_T1} "
       f"AND channel IN ({', '.join(map(str, WQ_CHANNELS))})")
def q_partial_read(spark, sf):
    out = run_dir(spark, "bronze")
    lake.write_bronze(spikes(spark, sf), out)
    return lake.partial_read(spark, out, WQ_CH_T0, WQ_CH_T1, WQ_CHANNELS)


_BUCKETS = ", ".join(str(c % lake.N_BUCKETS) for c in WQ_CHANNELS)


@query("partial_read_cost",
       f"WITH spikes AS ({SPIKES_SQL}), b AS (SELECT stream_id, channel, channel % {lake.N_BUCKETS} AS bucket FROM spikes) "
       f"SELECT stream_id, count(DISTINCT bucket) FILTER (WHERE bucket IN ({_BUCKETS})) AS partitions_read, "
       "count(DISTINCT bucket) AS partitions_total, "
       f"count(*) FILTER (WHERE channel IN ({', '.join(map(str, WQ_CHANNELS))})) AS events_read, "
       f"count(DISTINCT bucket) FILTER (WHERE bucket NOT IN ({_BUCKETS})) > 0 AS reads_less FROM b GROUP BY stream_id",
       note="partitions, files and bytes of a channel query; SQL knows no bytes, so it says whether some are saved")
def q_partial_read_cost(spark, sf):
    out = run_dir(spark, "bronze")
    lake.write_bronze(spikes(spark, sf), out)
    cost = EventLake(spark, out).query_cost(WQ_CHANNELS)
    return cost.select("stream_id", "partitions_read", "partitions_total", "events_read", (F.col("bytes_read") < F.col("bytes_total")).alias("reads_less"))


# enrollment: the library holds one reference per label; a newer enrollment replaces it
@query("enroll_library",
       f"WITH {NORM_SQL}, {SPLIT_SQL}, {PROTO_SQL}, "
       "tp AS (SELECT n.label, n.i, avg(n.v) AS v FROM norm n JOIN split s USING (window_id) WHERE s.split = 'test' "
       "AND CAST(n.label AS INTEGER) % 2 = 0 GROUP BY n.label, n.i), "
       "u AS (SELECT label, i, v, 1 AS version FROM proto UNION ALL SELECT label, i, v, 2 FROM tp) "
       "SELECT label, i, round(arg_max(v, version), 6) AS v, max(version) AS version FROM u GROUP BY label, i")
def q_enroll(spark, sf):
    sp = _split(spark, sf)
    old = match.prototype_rows(sp.filter(F.col("split") == "train")).withColumn("version", F.lit(1))
    new = match.prototype_rows(sp.filter((F.col("split") == "test") & (F.pmod(F.col("label").cast("int"), F.lit(2)) == 0)))
    lib = match.enroll(old, new.withColumn("version", F.lit(2)))
    return lib.select("label", "i", F.round("v", 6).alias("v"), "version")


@query("readout_fit", None, note="multinomial logistic regression (Spark ML); accuracy on the hold-out")
def q_readout_fit(spark, sf):
    from eventlake.operators import readout
    sp = _split(spark, sf)
    return readout.fit_readout(sp, "vec", "label", "split")


@query("sensor_capture", None, note="serial log -> windows -> match -> unknowns -> regimes per device")
def q_sensor_capture(spark, sf):
    from eventlake.plans.q_ingest import serial_line
    from eventlake.plans.q_signals import _library
    from eventlake.sources import adapters
    from eventlake.sources.tables import table
    li = table(spark, sf, "lineitem")
    # device = supplier; seq = the supplier's shipping order (the capture's row order)
    base = li.select(F.col("l_suppkey").alias("device_id"), *adapters.SAMPLE_ORDER, serial_line().alias("line"))
    week = F.floor(F.unix_date(F.col("l_shipdate").cast("date")) / F.lit(7)).cast("bigint")
    from eventlake.operators.ordered import seq_number
    lines = seq_number(base, ["device_id"], adapters.SAMPLE_ORDER, week).select(
        "device_id", "seq", "line")
    stats, regimes = pipeline.run_sensor_capture(lines, _library(spark, sf), window=8)
    return regimes
