"""Statistical bands and multiset comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stat_band(runs: DataFrame, metric: str = "metric", value: str = "value", k: float = 3.0) -> DataFrame:
    """Per metric: mean +- k * sample stddev (n = 1 -> sigma 0)."""
    s = runs.groupBy(metric).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                                  F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    s = s.withColumn("std", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("std")))
    return s.select(metric, "n", "mean", "std", (F.col("mean") - F.lit(k) * F.col("std")).alias("lo"),
                    (F.col("mean") + F.lit(k) * F.col("std")).alias("hi"))


def band_check(new: DataFrame, band: DataFrame, metric: str = "metric", value: str = "value",
               floor: float | None = None) -> DataFrame:
    """Flag each new value: inside the band, and (with a hand floor) whether the
    floor would pass a value the band rejects."""
    j = new.join(band.select(metric, "lo", "hi"), metric)
    out = j.withColumn("within", (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    if floor is not None:
        out = out.withColumn("floor_misses", (F.col(value) >= F.lit(floor)) & (F.col(value) < F.col("lo")))
    return out


def multiset_diff(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """One row: rows of ``a`` missing from ``b`` and rows of ``b`` not in ``a``
    (multiplicities respected), and whether the two multisets are equal.

    One shuffle: tag +1/-1, sum per distinct row, then aggregate.
    """
    tagged = a.select(*cols, F.lit(1).alias("__d")).unionByName(b.select(*cols, F.lit(-1).alias("__d")))
    per = tagged.groupBy(*cols).agg(F.sum("__d").alias("__d"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).cast("bigint").alias("missing"),
                   F.coalesce(F.sum(F.when(F.col("__d") < 0, -F.col("__d"))), F.lit(0)).cast("bigint").alias("extra")
                   ).withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))
