"""Event-camera framing, rate vectors, sparsity and prototype classification
(SURVEY D8, D9, E11, L3).  Frames stay sparse: (sample, frame, idx, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the camera model.
H = W = 34
P = 2
DUR = 300_000
T_BINS = 6


def frames(camera: DataFrame, t_bins: int = T_BINS, dur: int = DUR) -> DataFrame:
    """``frame = min(T-1, t*T // DUR)``, ``idx = (p % P)*H*W + y*W + x``,
    counts saturate at 255.  Negative t is rejected (it would wrap)."""
    ev = camera.filter(F.col("t") >= 0)
    b = F.least(F.lit(t_bins - 1), F.floor(F.col("t") * F.lit(t_bins) / F.lit(dur))).cast("int")
    idx = (F.pmod(F.col("p"), F.lit(P)) * F.lit(H * W) + F.col("y") * F.lit(W) + F.col("x")).cast("int")
    return (ev.groupBy("sample_id", "label", b.alias("frame"), idx.alias("idx"))
            .agg(F.least(F.count(F.lit(1)), F.lit(255)).cast("int").alias("cnt")))


def rate_vectors(fr: DataFrame, t_bins: int = T_BINS) -> DataFrame:
    """Sum of saturated frame counts / T per (sample, idx); only non-zero entries."""
    return fr.groupBy("sample_id", "label", "idx").agg((F.sum("cnt") / F.lit(float(t_bins))).alias("rate"))


def sparsity(rates: DataFrame, size: int = P * H * W) -> DataFrame:
    """Active fraction of each sample's rate vector."""
    return rates.groupBy("sample_id").agg((F.count_if(F.col("rate") > 0) / F.lit(float(size))).alias("active_fraction"))


def sparse_prototypes(rates: DataFrame) -> DataFrame:
    """Dense element-wise mean per label from sparse vectors: sum / n_samples(label)."""
    n = rates.groupBy("label").agg(F.countDistinct("sample_id").alias("n"))
    s = rates.groupBy("label", "idx").agg(F.sum("rate").alias("s"))
    return s.join(n, "label").select("label", "idx", (F.col("s") / F.col("n")).alias("v"))


def classify_sparse(rates: DataFrame, protos: DataFrame) -> DataFrame:
    """Nearest prototype by squared L2 with sparse algebra:
    ``|x|^2 + |p|^2 - 2 x.p``; the dot product joins on idx only where both
    are non-zero.  Every (sample, label) pair gets a distance."""
    xx = rates.groupBy("sample_id").agg(F.sum(F.col("rate") * F.col("rate")).alias("xx"))
    pp = protos.groupBy("label").agg(F.sum(F.col("v") * F.col("v")).alias("pp"))
    dot = (rates.select("sample_id", "idx", "rate").join(protos.select(F.col("label").alias("plabel"), "idx", "v"), "idx")
           .groupBy("sample_id", "plabel").agg(F.sum(F.col("rate") * F.col("v")).alias("xp")))
    from eventlake.operators.match import pair_with_library
    pairs = pair_with_library(xx, pp.withColumnRenamed("label", "plabel"))
    d = (pairs.join(dot, ["sample_id", "plabel"], "left")
         .select("sample_id", "plabel", (F.col("xx") + F.col("pp") - 2.0 * F.coalesce("xp", F.lit(0.0))).alias("d2")))
    best = d.groupBy("sample_id").agg(F.min(F.struct("d2", "plabel")).alias("b"))
    return best.select("sample_id", F.col("b.plabel").alias("pred"), F.col("b.d2").alias("d2"))
