"""Data-quality gates.

Gates return violation/report DataFrames; :func:`gate` runs them in one
aggregation pass and raises :class:`DataQualityError` before anything is
published (stage -> gate -> publish).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(AssertionError):
    """A gate failed; promotion must stop."""


def schema_violations(events: DataFrame, n_channels: int, duration: int) -> DataFrame:
    """Rows outside ``t in [0, duration)`` / ``channel in [0, n_channels)``
    (or null) with the first failing reason."""
    t, c = F.col("t"), F.col("channel")
    reason = (F.when(t.isNull() | c.isNull(), F.lit("null_field"))
              .when((t < 0) | (t >= F.lit(int(duration))), F.lit("t_out_of_range"))
              .when((c < 0) | (c >= F.lit(int(n_channels))), F.lit("channel_out_of_range")))
    return events.select("stream_id", "channel", "t", reason.alias("reason")).filter(F.col("reason").isNotNull())


def lossless(x: Column, as_type: str, back: str) -> Column:
    """True when ``x`` survives a round trip through ``as_type``."""
    return F.coalesce(x.try_cast(as_type).try_cast(back) == x, F.lit(False))


def encodable_report(candidate: DataFrame, t: str = "t", channel: str = "channel") -> DataFrame:
    """One row: rows, t values not losslessly int64, channels not losslessly int32."""
    tt = candidate.schema[t].dataType.simpleString()
    ct = candidate.schema[channel].dataType.simpleString()
    return candidate.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~lossless(F.col(t), "bigint", tt)).alias("bad_t"),
        F.count_if(~lossless(F.col(channel), "int", ct)).alias("bad_channel"),
    ).withColumn("passed", (F.col("bad_t") == 0) & (F.col("bad_channel") == 0))


def fingerprint(events: DataFrame) -> DataFrame:
    """Order-free content fingerprint per stream.

    Each row hashes to 60 bits of md5(stream:channel:t); the stream digest is
    the exact DECIMAL sum of those plus the row count, so it merges across
    partitions without sorting or collecting anything.
    """
    key = F.concat_ws(":", F.col("stream_id"), F.col("channel").cast("string"), F.col("t").cast("string"))
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("decimal(38,0)")
    agg = events.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("__s"))
    digest = F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("__s").cast("string")), 256)
    return agg.select("stream_id", "n_rows", F.col("__s").cast("string").alias("hash_sum"), digest.alias("fingerprint"))


def immutability_violations(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Streams whose fingerprint differs from the one recorded at ingest."""
    now = fingerprint(events).select("stream_id", F.col("fingerprint").alias("now"))
    return (manifest.select("stream_id", F.col("fingerprint").alias("recorded"))
            .join(now, "stream_id", "full_outer")
            .filter(~F.col("recorded").eqNullSafe(F.col("now"))))


def _finite_nonneg(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c != F.lit(float("inf"))) & (c >= 0)


def gold_report(gold: DataFrame, icr: DataFrame | None = None) -> DataFrame:
    """Per stream: rates finite and >= 0, synchrony finite and >= 0, ICR in (0, 1]."""
    rep = gold.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.bool_and(_finite_nonneg(F.col("rate"))).alias("rates_ok"),
        F.bool_and(_finite_nonneg(F.col("synchrony_cv"))).alias("synchrony_ok"))
    if icr is not None:
        i = F.col("icr")
        rep = rep.join(icr.select("stream_id", (i.isNotNull() & ~F.isnan(i) & (i > 0) & (i <= 1)).alias("icr_ok")),
                       "stream_id", "left").withColumn("icr_ok", F.coalesce("icr_ok", F.lit(False)))
        ok = F.col("rates_ok") & F.col("synchrony_ok") & F.col("icr_ok")
    else:
        ok = F.col("rates_ok") & F.col("synchrony_ok")
    return rep.withColumn("passed", ok)


def gate(events: DataFrame, n_channels: int | None, duration: int | None, gold: DataFrame | None = None,
         icr: DataFrame | None = None, manifest: DataFrame | None = None) -> dict:
    """Run K1 -> K4 and raise on the first failure; return a small report.

    ``n_channels`` and ``duration`` are declared bounds; without one only null
    and negative values are out of range.  Schema and encodability are checked
    in one aggregation pass; only the one-row summaries reach the driver.
    """
    t, c = F.col("t"), F.col("channel")
    out = t.isNull() | c.isNull() | (t < 0) | (c < 0)
    if duration is not None:
        out = out | (t >= F.lit(int(duration)))
    if n_channels is not None:
        out = out | (c >= F.lit(int(n_channels)))
    tt = events.schema["t"].dataType.simpleString()
    ct = events.schema["channel"].dataType.simpleString()
    row = events.agg(F.count(F.lit(1)).alias("rows"), F.count_if(out).alias("bad_schema"),
                     F.count_if(~lossless(t, "bigint", tt) | ~lossless(c, "int", ct)).alias("bad_encoding")).first()
    if row["bad_schema"]:
        raise DataQualityError(f"{row['bad_schema']} rows violate t in [0,{duration}) / channel in [0,{n_channels})")
    if row["bad_encoding"]:
        raise DataQualityError(f"{row['bad_encoding']} rows are not losslessly encodable")
    if manifest is not None and not immutability_violations(events, manifest).isEmpty():
        raise DataQualityError("Bronze mutated since ingest (fingerprint differs)")
    if gold is not None:
        bad = gold_report(gold, icr).filter(~F.col("passed")).limit(1).collect()
        if bad:
            raise DataQualityError(f"gold gate failed for stream {bad[0]['stream_id']}")
    return {"rows": row["rows"], "n_channels": n_channels, "duration": duration, "gold_checked": gold is not None}
