"""Array transforms and spike encoders.

Vectors are ``ARRAY<DOUBLE>`` columns; encodings are exploded event rows
``(id, t, i)`` so that joins on the feature index stay equi-joins.
All of it is native expressions (``transform``/``filter``/``sequence``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions.rng import hash_uniform

# Fixed values of the signal model.
N = 64          # features per window
T = 32          # time steps
FLOOR = 0.10    # dimmer features never spike
TAU = 4.0       # Van Rossum decay constant
FLAT_EPS = 1e-9


def _c(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def resize(vec: Column | str, n: int = N) -> Column:
    """Truncate or zero-pad to exactly ``n`` features."""
    v = _c(vec)
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), F.lit(int(n)))), 1, int(n))


def normalize(vec: Column | str, n: int = N) -> Column:
    """Pad/truncate to ``n`` first (padding zeros count for the minimum), then
    min-max to [0, 1]; a flat vector (range <= 1e-9) becomes all zeros."""
    v = resize(vec, n)
    lo, hi = F.array_min(v), F.array_max(v)
    rng = hi - lo
    return F.when(rng > F.lit(FLAT_EPS), F.transform(v, lambda x: (x - lo) / rng)).otherwise(
        F.array_repeat(F.lit(0.0), F.lit(int(n))))


def normalized(df: DataFrame, vec: str, out: str = "vec", n: int = N) -> DataFrame:
    """DataFrame form of :func:`normalize`: the own elements, their minimum and
    range are materialised as columns first so the per-element lambda only
    reads them (no re-evaluation of array_min/array_max per element).  The
    padding is one value, repeated, not computed element by element."""
    d = df.withColumn("__v", F.slice(vec, 1, int(n))).withColumn("__pad", F.lit(int(n)) - F.size("__v"))
    zero = F.when(F.col("__pad") > 0, F.lit(0.0))
    d = d.withColumn("__lo", F.least(F.array_min("__v"), zero)).withColumn("__rng", F.greatest(F.array_max("__v"), zero) - F.col("__lo"))
    scaled = lambda x: (x - F.col("__lo")) / F.col("__rng")
    res = F.when(F.col("__rng") > F.lit(FLAT_EPS),
                 F.concat(F.transform("__v", scaled), F.array_repeat(scaled(F.lit(0.0)), F.col("__pad")))).otherwise(
        F.array_repeat(F.lit(0.0), F.lit(int(n))))
    return d.withColumn(out, res).drop("__v", "__pad", "__lo", "__rng")


def binarize(vec: Column | str, thr: float = 0.5) -> Column:
    return F.transform(_c(vec), lambda x: F.when(x >= F.lit(thr), F.lit(1)).otherwise(F.lit(0)))


def _features(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(id_col, F.posexplode_outer(vec).alias("i", "v")).filter(F.col("i").isNotNull())


def latency_events(df: DataFrame, id_col: str = "window_id", vec: str = "vec", t_steps: int = T,
                   floor: float = FLOOR) -> DataFrame:
    """One event per feature ``v >= floor`` at ``round_half_even((1-v)(T-1))``."""
    f = _features(df, id_col, vec).filter(F.col("v") >= F.lit(floor))
    return f.select(id_col, F.bround((F.lit(1.0) - F.col("v")) * F.lit(t_steps - 1), 0).cast("int").alias("t"),
                    F.col("i").cast("int").alias("i"))


def latency_array(vec: Column | str, t_steps: int = T, floor: float = FLOOR) -> Column:
    """Array form of the latency code: sorted ARRAY<STRUCT<t, i>>."""
    ev = F.transform(_c(vec), lambda v, i: F.when(v >= F.lit(floor), F.struct(
        F.bround((F.lit(1.0) - v) * F.lit(t_steps - 1), 0).cast("int").alias("t"), i.cast("int").alias("i"))))
    return F.array_sort(F.filter(ev, lambda e: e.isNotNull()))


def ttfs_events(df: DataFrame, id_col: str = "window_id", vec: str = "vec", t_steps: int = T,
                floor: float = FLOOR) -> DataFrame:
    """Time-to-first-spike: ``int((1-v)(T-1))`` (truncation), none below floor."""
    f = _features(df, id_col, vec).filter(F.col("v") >= F.lit(floor))
    return f.select(id_col, ((F.lit(1.0) - F.col("v")) * F.lit(t_steps - 1)).cast("int").alias("t"),
                    F.col("i").cast("int").alias("i"))


def burst_events(df: DataFrame, burst: int, id_col: str = "window_id", vec: str = "vec", t_steps: int = T,
                 floor: float = FLOOR) -> DataFrame:
    """Graded burst: ``max(1, round(v*B))`` consecutive spikes from the latency
    time, cut at T (both roundings half-even)."""
    f = _features(df, id_col, vec).filter(F.col("v") >= F.lit(floor))
    t0 = F.bround((F.lit(1.0) - F.col("v")) * F.lit(t_steps - 1), 0).cast("int")
    nb = F.greatest(F.lit(1), F.bround(F.col("v") * F.lit(int(burst)), 0).cast("int"))
    return (f.select(id_col, F.col("i").cast("int").alias("i"),
                     F.explode(F.sequence(t0, t0 + nb - 1)).alias("t"))
            .filter(F.col("t") < F.lit(t_steps)).select(id_col, "t", "i"))


def poisson_events(df: DataFrame, seed: int, rate: float = 0.5, id_col: str = "window_id", vec: str = "vec",
                   t_steps: int = T, floor: float = FLOOR) -> DataFrame:
    """Rate code: each feature ``v >= floor`` fires at step t with probability
    ``v*rate``; the uniform is keyed by (seed, id, i, t), so it is reproducible
    and independent of partitioning."""
    f = _features(df, id_col, vec).filter(F.col("v") >= F.lit(floor))
    f = f.select(id_col, "i", "v", F.explode(F.sequence(F.lit(0), F.lit(t_steps - 1))).alias("t"))
    u = hash_uniform(seed, F.col(id_col), F.col("i"), F.col("t"))
    return f.filter(u < F.col("v") * F.lit(rate)).select(id_col, F.col("t").cast("int").alias("t"),
                                                          F.col("i").cast("int").alias("i"))


def binary_rate_events(df: DataFrame, seed: int, on: float = 0.9, off: float = 0.05, id_col: str = "window_id",
                       vec: str = "bits", t_steps: int = T) -> DataFrame:
    """Binary rate code: a lit input fires with probability ``on`` per step, an
    unlit one with ``off``."""
    f = _features(df, id_col, vec).select(id_col, "i", "v",
                                          F.explode(F.sequence(F.lit(0), F.lit(t_steps - 1))).alias("t"))
    p = F.when(F.col("v") > 0, F.lit(on)).otherwise(F.lit(off))
    return f.filter(hash_uniform(seed, F.col(id_col), F.col("i"), F.col("t")) < p).select(
        id_col, F.col("t").cast("int").alias("t"), F.col("i").cast("int").alias("i"))


def decay_trace(events: DataFrame, id_col: str = "window_id", t_steps: int = T, tau: float = TAU) -> DataFrame:
    """Van Rossum trace per (id, feature): ``w[t] = sum_{s<=t} exp(-(t-s)/tau)``
    over events inside [0, T); rows only where ``t >= first event``."""
    ev = events.filter((F.col("t") >= 0) & (F.col("t") < F.lit(t_steps)))
    per = ev.groupBy(id_col, "i").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    grid = per.select(id_col, "i", "ts", F.explode(F.sequence(F.array_min("ts"), F.lit(t_steps - 1))).alias("t"))
    w = F.aggregate(F.filter("ts", lambda s: s <= F.col("t")), F.lit(0.0),
                    lambda acc, s: acc + F.exp(-(F.col("t") - s).cast("double") / F.lit(tau)))
    return grid.select(id_col, "i", F.col("t").cast("int").alias("t"), w.alias("w"))


def kernel(a: Column, b: Column, t_steps: int = T, tau: float = TAU) -> Column:
    """Closed-form inner product of two single-spike Van Rossum traces on [0, T):
    ``exp(-|a-b|/tau) * (1 - q^(T - max(a,b))) / (1 - q)``, ``q = exp(-2/tau)``."""
    q = math.exp(-2.0 / tau)
    m = F.greatest(a, b)
    return (F.exp(-F.abs(a - b).cast("double") / F.lit(tau))
            * (F.lit(1.0) - F.pow(F.lit(q), (F.lit(t_steps) - m).cast("double"))) / F.lit(1.0 - q))


def count_windows(samples: DataFrame, window: int, n: int = N, key: str = "device_id") -> DataFrame:
    """Consecutive ``window`` samples per key -> row-major flatten -> resize ->
    normalise.  Incomplete tails are dropped; ``window <= 1`` = one row each.

    Expects ``seq`` (1-based, gap-free per key) and ``vals`` ARRAY<DOUBLE>.
    Groups hold exactly ``window`` rows, so no group is unbounded.
    """
    wsize = max(1, int(window))
    g = samples.withColumn("win", F.floor((F.col("seq") - 1) / F.lit(wsize)).cast("bigint"))
    agg = g.groupBy(key, "win").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("seq", "vals"))).alias("rows"),
        F.min_by("label", "seq").alias("label") if "label" in samples.columns else F.lit(None).alias("label"))
    flat = F.flatten(F.transform("rows", lambda r: r["vals"]))
    full = agg.filter(F.col("n_rows") == wsize).select(key, F.col("win").alias("window_id"), "label",
                                                      flat.alias("flat"))
    return normalized(full, "flat", "vec", n).drop("flat")
