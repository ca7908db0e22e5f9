"""User-level jobs built from the operators.

run_medallion: gate the source -> Bronze (fingerprint of the source first) ->
Silver, Gold and ICR in the run's own folders -> gate -> latency hand-off and
top-5 SQL -> publish by pointer -> external table refresh.  Nothing is
published when a gate fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import medallion, quality, store
from eventlake.sources import lake


@dataclass
class MedallionResult:
    bronze: str
    silver: str
    gold: str
    report: dict


def run_medallion(spark: SparkSession, source: DataFrame, out: str, window: int, n_channels: int | None = None,
                  duration: int | None = None, table: str | None = None, t_steps: int = 32) -> MedallionResult:
    """One run: gate the source, land Bronze, stage Silver/Gold/ICR, gate them,
    publish, hand off.

    * K1, K2 look at the *source*, before any cast, against declared bounds
      (without them only null and negative values can be out of range).
    * K3: the source is fingerprinted before it is written and Bronze is compared
      with that; Bronze of the run before is compared with its own manifest
      first, so a change between two runs is seen.
    * K4 covers rates, synchrony and ICR.
    * Each run writes its own folders; the pointer table ``_current`` names the
      published one and is written last.
    """
    run = uuid.uuid4().hex[:12]
    base = f"{out}/runs/{run}"
    before = current_run(spark, out)
    if before is not None:
        old = lake.read_bronze(spark, f"{before}/bronze").select("stream_id", "channel", "t")
        if not quality.immutability_violations(old, spark.read.parquet(f"{before}/manifest")).isEmpty():
            raise quality.DataQualityError("Bronze of the run before has changed (fingerprint differs)")
    quality.gate(source, n_channels, duration)
    manifest_path, bronze_path = f"{base}/manifest", f"{base}/bronze"
    landed = medallion.bronze(source)
    quality.fingerprint(landed).write.parquet(manifest_path)
    lake.write_bronze(landed, bronze_path)
    bronze = lake.read_bronze(spark, bronze_path).select("stream_id", "channel", "t")

    lake.write_layer(medallion.silver(bronze, window), f"{base}/silver")
    silver = spark.read.parquet(f"{base}/silver")
    lake.write_layer(medallion.icr(silver, window, duration, n_channels), f"{base}/icr")
    icr = spark.read.parquet(f"{base}/icr")
    gold = medallion.gold(bronze, silver, duration).join(icr.select("stream_id", "icr"), "stream_id", "left")
    lake.write_layer(gold, f"{base}/gold")
    gold = spark.read.parquet(f"{base}/gold")
    report = quality.gate(bronze, n_channels, duration, gold=gold, icr=icr, manifest=spark.read.parquet(manifest_path))

    lake.write_layer(medallion.latency_handoff(gold, t_steps), f"{base}/handoff")
    store.top_by_rate_sql(gold, 5).write.parquet(f"{base}/top_channels")
    # publish: the pointer is the only thing that changes
    spark.createDataFrame([(run,)], "run string").write.mode("append").parquet(f"{out}/_current")
    if table:
        lake.refresh_table(spark, table, f"{base}/gold")
    return MedallionResult(bronze_path, f"{base}/silver", f"{base}/gold", report)


def current_run(spark: SparkSession, out: str) -> str | None:
    """Folder of the run published last, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_current")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{out}/_current").select("run", F.col("_metadata.file_modification_time").alias("at"))
    last = rows.orderBy(F.col("at").desc(), F.col("run").desc()).limit(1).collect()
    return f"{out}/runs/{last[0]['run']}" if last else None


def gold_queries(spark: SparkSession, gold_path: str, t_steps: int = 32) -> tuple[DataFrame, DataFrame]:
    gold = spark.read.parquet(gold_path)
    return medallion.latency_handoff(gold, t_steps), store.top_by_rate_sql(gold, 5)


def run_sensor_capture(lines: DataFrame, library: DataFrame, window: int = 8, radius: float | None = None,
                       key: str = "device_id") -> tuple[DataFrame, DataFrame]:
    """Serial capture -> parsed rows -> count windows -> nearest reference with
    ratio test -> unknowns -> leader clusters per device -> promoted regimes.

    ``lines`` = (key, seq, line); ``library`` = (label, vec).  Returns
    (match statistics per device, promoted regimes (key, label, size)).
    """
    from eventlake.operators import cluster, encode, match
    from eventlake.sources import parse

    parsed = parse.serial_log(lines.select(F.struct(key, "seq").alias("line_id"), "line"))
    parsed = parsed.select(F.col("line_id")[key].alias(key), F.col("line_id.seq").alias("old_seq"), "vals")
    # renumber the surviving rows gap-free per device (banners/headers dropped)
    from eventlake.operators.ordered import seq_number
    numbered = seq_number(parsed, [key], ["old_seq"], F.floor(F.col("old_seq") / F.lit(1 << 16)).cast("bigint"))
    wins = encode.count_windows(numbered.drop("old_seq"), window, key=key)
    wins = wins.withColumn("wid", F.concat_ws(":", F.col(key).cast("string"), F.col("window_id").cast("string")))
    res = match.ratio_match(match.nearest_two(wins, library, win_id="wid"))
    stats = res.groupBy(key).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("matched")).alias("matched"),
                                 F.count_if(~F.col("matched")).alias("novel"))
    unknowns = res.filter(~F.col("matched")).select(key, F.col("window_id").alias("seq"), "vec")
    if radius is None:
        radius = cluster.auto_radius(library).first()["radius"]
    assign = cluster.leader_clusters(unknowns, radius, key=key)
    regimes = cluster.promote(cluster.cluster_summary(unknowns, assign, key=key), key=key)
    return stats, regimes.select(key, "label", "size")
