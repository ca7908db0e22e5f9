"""Discovering recurring unknown signals.

leader_clusters: order-dependent leader clustering — each unknown joins the
nearest cluster (Van Rossum distance to the latency code of the cluster's
running mean) when within ``radius``, else starts a new cluster.  The
algorithm is sequential by definition, so it runs as an ordered fold per
stream key (rows streamed in ``seq`` order; memory = the clusters, not the
rows).  promote: clusters with ``size >= min_support`` become library
entries ``DISCOVERED_n`` (largest first, numbering continues), optionally
naming the largest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators import encode
from eventlake.operators.ordered import ordered_fold

MIN_SUPPORT = 3     # fixed value: repeats before a novel signal becomes a signature


def _latency_times(v: np.ndarray, t_steps: int = encode.T, floor: float = encode.FLOOR) -> np.ndarray:
    """Per feature: spike time (half-even rounding) or -1."""
    t = np.rint((1.0 - v) * (t_steps - 1))
    return np.where(v >= floor, t, -1.0)


def _vr(a: np.ndarray, b: np.ndarray, t_steps: int = encode.T, tau: float = encode.TAU) -> np.ndarray:
    """Van Rossum distances between one code ``a`` (N,) and codes ``b`` (C, N)."""
    q = math.exp(-2.0 / tau)

    def k(x, y):
        m = np.maximum(x, y)
        return np.exp(-np.abs(x - y) / tau) * (1.0 - q ** (t_steps - m)) / (1.0 - q)

    ha, hb = a >= 0, b >= 0
    self_a = np.where(ha, k(a, a), 0.0).sum()
    self_b = np.where(hb, k(b, b), 0.0).sum(axis=1)
    cross = np.where(ha & hb, k(np.broadcast_to(a, b.shape), b), 0.0).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (self_a + self_b - 2.0 * cross) / tau))


def leader_clusters(unknowns: DataFrame, radius: float, key: str = "stream_id", seq: str = "seq",
                    vec: str = "vec") -> DataFrame:
    """(key, seq, cluster_id) per unknown, cluster ids 0.. in creation order."""
    ktype = unknowns.schema[key].dataType.simpleString()
    src = unknowns.select(F.col(key).alias("k"), F.col(seq).alias("seq"), F.col(vec).alias("vec"))

    def make_fold():
        st = {"k": None, "sums": [], "counts": [], "codes": None}

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for k, s, v in zip(pdf["k"].tolist(), pdf["seq"].tolist(), pdf["vec"].tolist()):
                if k != st["k"]:
                    st.update(k=k, sums=[], counts=[], codes=None)
                v = np.asarray(v, dtype=np.float64)
                code = _latency_times(v)
                cid = -1
                if st["codes"] is not None and len(st["counts"]):
                    d = _vr(code, st["codes"])
                    j = int(np.argmin(d))
                    if d[j] <= radius:
                        cid = j
                if cid >= 0:
                    st["sums"][cid] = st["sums"][cid] + v
                    st["counts"][cid] += 1
                    st["codes"][cid] = _latency_times(st["sums"][cid] / st["counts"][cid])
                else:
                    st["sums"].append(v.copy())
                    st["counts"].append(1)
                    st["codes"] = code[None, :] if st["codes"] is None else np.vstack([st["codes"], code])
                    cid = len(st["counts"]) - 1
                out.append((k, s, cid))
            return pd.DataFrame(out, columns=["k", "seq", "cluster_id"]).astype({"seq": "int64", "cluster_id": "int64"})

        return fold

    res = ordered_fold(src, ["k"], ["seq"], make_fold, f"k {ktype}, seq long, cluster_id long")
    return res.withColumnRenamed("k", key)


def cluster_summary(unknowns: DataFrame, assignments: DataFrame, key: str = "stream_id", seq: str = "seq",
                    vec: str = "vec") -> DataFrame:
    """(key, cluster_id, size, vec = element-wise mean)."""
    j = unknowns.select(key, seq, F.posexplode_outer(vec).alias("i", "v")).join(assignments, [key, seq])
    m = j.groupBy(key, "cluster_id", "i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("size"))
    return m.groupBy(key, "cluster_id").agg(
        F.max("size").alias("size"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vec"))


def promote(clusters: DataFrame, library_labels: DataFrame | None = None, key: str = "stream_id",
            min_support: int = MIN_SUPPORT, name_largest: str | None = None) -> DataFrame:
    """Clusters with ``size >= min_support`` -> (key, label, size, vec):
    ``DISCOVERED_{base + rank}`` ordered by size desc (ties: cluster id),
    ``base`` = DISCOVERED_ labels already in the library."""
    keep = clusters.filter(F.col("size") >= min_support)
    w = Window.partitionBy(key).orderBy(F.col("size").desc(), F.col("cluster_id"))
    ranked = keep.withColumn("rank", F.row_number().over(w))
    if library_labels is not None:
        base = library_labels.agg(F.count_if(F.col("label").startswith("DISCOVERED_")).alias("base"))
        ranked = ranked.join(F.broadcast(base), how="cross")
    else:
        ranked = ranked.withColumn("base", F.lit(0))
    name = F.concat(F.lit("DISCOVERED_"), (F.col("base") + F.col("rank")).cast("string"))
    if name_largest:
        name = F.when(F.col("rank") == 1, F.lit(name_largest)).otherwise(name)
    return ranked.select(key, name.alias("label"), "size", "vec")


def auto_radius(library: DataFrame, seed: int = 0, noise: float = 0.08, vec: str = "vec") -> DataFrame:
    """1.5 x mean Van Rossum distance between each reference and a jittered
    copy (jitter = keyed uniform in [-noise, noise], clipped to [0, 1])."""
    from eventlake.functions.rng import hash_uniform
    from eventlake.operators import match
    jit = library.select("label", F.transform(vec, lambda v, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + (
        hash_uniform(seed, F.col("label"), i) * 2 - 1) * F.lit(noise)))).alias(vec))
    d = match.van_rossum(jit.withColumnRenamed("label", "window_id"), library, vec=vec)
    return d.filter(F.col("window_id") == F.col("label")).agg((F.avg("dist") * 1.5).alias("radius"))


def close_loop(spark, base: str, library: DataFrame, radius: float | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """One turn of discovery: the recorded unknowns not consumed so far are
    clustered per stream, clusters with enough support join the library as
    ``DISCOVERED_<n>`` (numbering goes on over streams and turns), and all of
    them are marked consumed.  Returns (label, vec): the library after it.

    ``{base}/unknowns`` holds the records, ``{base}/consumed`` their keys.
    """
    from eventlake.session import cut_lineage
    from eventlake.sources import lake

    fresh = lake.read_unknowns(spark, f"{base}/unknowns")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/consumed")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        fresh = fresh.join(spark.read.parquet(f"{base}/consumed"), ["stream_id", "seq"], "left_anti")
    fresh = cut_lineage(fresh)
    if radius is None:
        radius = auto_radius(library).first()["radius"]
    found = cluster_summary(fresh, leader_clusters(fresh, radius or 0.0)).filter(F.col("size") >= min_support)
    have = library.where(F.col("label").startswith("DISCOVERED_")).count()
    order = Window.orderBy(F.col("size").desc(), "stream_id", "cluster_id")      # promoted clusters only
    new = found.select(F.concat(F.lit("DISCOVERED_"), (F.row_number().over(order) + have).cast("string")).alias("label"), "vec")
    grown = cut_lineage(library.select("label", "vec").unionByName(new))
    fresh.select("stream_id", "seq").write.mode("append").parquet(f"{base}/consumed")
    return grown
