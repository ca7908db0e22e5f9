"""Bronze/Silver/Gold layout on Parquet.

Bronze is partitioned by ``(stream_id, channel_bucket)`` and sorted by
``(channel, t)`` inside files, so a channel list prunes partitions and a
t-range skips row groups by their min/max statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_BUCKETS = 16


def channel_bucket(channel) -> F.Column:
    c = channel if isinstance(channel, F.Column) else F.col(channel)
    return F.pmod(c, F.lit(N_BUCKETS)).cast("int")


def write_bronze(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Range-partitioned by (stream, bucket, channel, t): a stream of any size is
    written by as many tasks as its share of the rows asks for."""
    out = events.withColumn("channel_bucket", channel_bucket("channel"))
    (out.repartitionByRange("stream_id", "channel_bucket", "channel", "t")
     .sortWithinPartitions("stream_id", "channel_bucket", "channel", "t")
     .write.mode(mode).partitionBy("stream_id", "channel_bucket").parquet(path))


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def partial_read(spark: SparkSession, path: str, t0: int, t1: int, channels: Sequence[int]) -> DataFrame:
    """Window query that touches only the partitions of the queried channels
    (PartitionFilters) and pushes the t-range to the scan (PushedFilters)."""
    chans = sorted({int(c) for c in channels})
    buckets = sorted({c % N_BUCKETS for c in chans})
    df = read_bronze(spark, path)
    return (df.filter(F.col("channel_bucket").isin(buckets) & F.col("channel").isin(chans)
                      & (F.col("t") >= t0) & (F.col("t") < t1))
            .select("stream_id", "channel", "t"))


def scan_stats(spark: SparkSession, path: str, channels: Sequence[int] | None = None) -> DataFrame:
    """What a query of these channels (none: all) reads of a Bronze table, after
    partition pruning: ``stream_id, partitions_read, partitions_total,
    files_read, files_total, bytes_read, bytes_total``, one row per stream.

    Counted from the file listing alone; no file is opened.  The t-range skips
    row groups inside these files, so ``bytes_read`` is an upper bound.  Streams
    that hold none of the channels have zeros.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    hit = F.lit(True) if channels is None else F.col("channel_bucket").isin(sorted({int(c) % N_BUCKETS for c in channels}))
    return files.groupBy(F.col("stream_id").cast("string").alias("stream_id")).agg(
        F.count_distinct(F.when(hit, F.col("channel_bucket"))).alias("partitions_read"), F.count_distinct("channel_bucket").alias("partitions_total"),
        F.count_if(hit).alias("files_read"), F.count(F.lit(1)).alias("files_total"),
        F.coalesce(F.sum(F.when(hit, F.col("length"))), F.lit(0)).alias("bytes_read"), F.sum("length").alias("bytes_total"))


def write_layer(df: DataFrame, path: str, partition_by: Sequence[str] = ("stream_id",)) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def refresh_table(spark: SparkSession, name: str, path: str) -> None:
    """External Parquet table over a path; refreshed after an overwrite."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING PARQUET LOCATION '{path}'")
    if spark.table(name).columns and spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(
            "col_name = '# Partition Information'").count():
        spark.sql(f"MSCK REPAIR TABLE {name}")    # register partitions written by the overwrite
    spark.sql(f"REFRESH TABLE {name}")


def save_encodings(windows: DataFrame, encoded: DataFrame, path: str, vec: str = "vec",
                   id_col: str = "window_id") -> DataFrame:
    """Materialise encodings once, keyed by a content hash of the input vector:
    inputs whose hash is in the folder already are skipped.  Returns what was added."""
    from eventlake.session import cut_lineage

    spark = windows.sparkSession
    keyed = windows.select(id_col, F.sha2(F.to_json(F.col(vec)), 256).alias("input_hash"))
    out = encoded.join(keyed, id_col)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        out = out.join(spark.read.parquet(path).select("input_hash").distinct(), "input_hash", "left_anti")
    out = cut_lineage(out.select(*encoded.columns, "input_hash"))
    out.write.mode("append").parquet(path)
    return out


def read_capture_csv(spark: SparkSession, path: str, schema: str = "label string, Sensor_1 double, Sensor_2 double") -> DataFrame:
    """Labelled capture CSVs: the row order inside each file is the sequence.

    The line number comes from the file, not from how Spark splits it: rows are
    ordered by (file, start of their split, position in the split), which the
    scan reports, and numbered per split plus the counts of earlier splits.
    """
    from eventlake.operators.ordered import seq_number

    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__split"),
                   F.monotonically_increasing_id().alias("__row"))
    return seq_number(df, ["source_file"], ["__split", "__row"], F.col("__split")).drop("__split", "__row")


def read_unknowns(spark: SparkSession, path: str) -> DataFrame:
    """Unknown windows recorded as JSON lines: (stream_id, seq, dist, vec)."""
    return spark.read.schema("stream_id string, seq bigint, dist double, vec array<double>").json(path)


def write_unknowns(unknowns: DataFrame, path: str) -> None:
    """Record novel windows as JSON lines, values to four digits."""
    (unknowns.select("stream_id", "seq", F.round("dist", 4).alias("dist"), F.transform("vec", lambda x: F.round(x, 4)).alias("vec"))
     .write.mode("append").json(path))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """A signature library kept as one JSON object label -> vector: (label, vec)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("label", "vec"))
