"""Matching encoded windows against a reference library.

The library is a small reference set (one vector per label), computed once and
checked in bytes.  As one broadcast row of spike-time arrays it makes all
distances of a window a projection (:func:`with_distances`); beyond the bound
windows meet hash chunks of the library, joined on the chunk id, so no task
ever holds more than one chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.operators import encode
from eventlake.operators.ordered import seq_number
from eventlake.session import cut_lineage

RATIO = 0.85    # fixed value: match only if best < RATIO * second


def prototypes(windows: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """Element-wise mean per label -> (label, vec)."""
    f = windows.select(label, F.posexplode_outer(vec).alias("i", "v")).filter(F.col("i").isNotNull())
    m = f.groupBy(label, "i").agg(F.avg("v").alias("v"))
    return m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("__p")).select(
        label, F.transform("__p", lambda s: s["v"]).alias(vec))


def prototype_rows(windows: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """Exploded prototypes (label, i, v)."""
    f = windows.select(label, F.posexplode_outer(vec).alias("i", "v")).filter(F.col("i").isNotNull())
    return f.groupBy(label, "i").agg(F.avg("v").alias("v"))


def pair_with_library(left: DataFrame, library: DataFrame, max_broadcast_rows: int = 100_000,
                      chunk_rows: int = 50_000) -> DataFrame:
    """All (left row, library row) pairs of a size-checked reference library."""
    n = library.count()
    if n <= max_broadcast_rows:
        return left.join(F.broadcast(library), how="cross")
    chunks = int(math.ceil(n / chunk_rows))
    lib = library.withColumn("__chunk", F.pmod(F.xxhash64(*library.columns), F.lit(chunks)).cast("int"))
    rep = left.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return rep.join(lib, "__chunk").drop("__chunk")


def spike_times(vec: Column | str, t_steps: int = encode.T, floor: float = encode.FLOOR) -> Column:
    """Latency code as one array: a feature's spike time, or -1 without a spike."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v, lambda x: F.when(x >= F.lit(floor), F.bround((F.lit(1.0) - x) * F.lit(t_steps - 1), 0).cast("int"))
                       .otherwise(F.lit(-1)))


def kernel_values(t_steps: int, tau: float) -> np.ndarray:
    """``K(a, b)`` of all pairs of spike times."""
    q = math.exp(-2.0 / tau)
    value = lambda a, b: math.exp(-abs(a - b) / tau) * (1.0 - q ** (t_steps - max(a, b))) / (1.0 - q)
    return np.array([[value(a, b) for b in range(t_steps)] for a in range(t_steps)])


def _kernel_table(t_steps: int, tau: float) -> Column:
    """All ``K(a, b)`` of two spike times as one constant array, row by row."""
    return F.expr("array(" + ", ".join(f"{x!r}D" for x in kernel_values(t_steps, tau).reshape(-1).tolist()) + ")")


def overlap_energy(a: Column, b: Column, table: Column, t_steps: int = encode.T) -> Column:
    """Inner product of the traces of two spike-time arrays."""
    k = F.zip_with(a, b, lambda x, y: F.when((x >= 0) & (y >= 0), F.get(table, x * F.lit(t_steps) + y)).otherwise(F.lit(0.0)))
    return F.aggregate(k, F.lit(0.0), lambda s, x: s + x)


def with_distances(windows: DataFrame, library: DataFrame, vec: str = "vec", label: str = "label",
                   t_steps: int = encode.T, tau: float = encode.TAU, max_bytes: int = 8 << 20) -> DataFrame:
    """The windows with ``dists``: ARRAY<STRUCT<dist, label>> to every reference.

    The library is computed once and its size checked in bytes.  Up to
    ``max_bytes`` it is one broadcast row and the distances are a projection:
    windows are not shuffled.  A larger one is cut into chunks of that size;
    each window meets each chunk, giving one row per (window, chunk).
    """
    packed, chunks = _references(library, vec, label, t_steps, tau, max_bytes)
    return _all_distances(windows, packed, chunks, vec, t_steps, tau)


def _references(library: DataFrame, vec: str, label: str, t_steps: int, tau: float, max_bytes: int) -> tuple[DataFrame, int]:
    """The library computed once, as one row a chunk (__chunk, __refs), and the number of chunks."""
    table = _kernel_table(t_steps, tau)
    refs = cut_lineage(library.select(F.col(label).cast("string").alias("label"), spike_times(vec, t_steps).alias("times"))
                       .withColumn("energy", overlap_energy(F.col("times"), F.col("times"), table, t_steps)))
    n, features = refs.agg(F.count(F.lit(1)), F.max(F.size("times"))).first()
    chunks = max(1, -(-(n * (4 * (features or 0) + 64)) // max_bytes))
    packed = (refs.withColumn("__chunk", F.pmod(F.xxhash64("label"), F.lit(chunks)).cast("int"))
              .groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct("label", "times", "energy"))).alias("__refs")))
    return packed, chunks


def _all_distances(windows: DataFrame, packed: DataFrame, chunks: int, vec: str, t_steps: int, tau: float) -> DataFrame:
    table = _kernel_table(t_steps, tau)
    own = windows.withColumn("__times", spike_times(vec, t_steps))
    own = own.withColumn("__energy", overlap_energy(F.col("__times"), F.col("__times"), table, t_steps))
    if chunks == 1:
        met = own.join(F.broadcast(packed.select("__refs")), how="left")
    else:
        # a window's row, as ids may repeat: the chunks of one row are merged again
        met = own.withColumn("__row", F.monotonically_increasing_id()).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(packed, "__chunk")
        met = met.withColumnRenamed("__chunk", "__chunks")
    square = lambda r: (F.col("__energy") + r["energy"]
                        - F.lit(2.0) * overlap_energy(F.col("__times"), r["times"], table, t_steps)) / F.lit(tau)
    dists = F.transform(F.coalesce("__refs", F.array().cast("array<struct<label:string,times:array<int>,energy:double>>")),
                        lambda r: F.struct(F.sqrt(F.greatest(F.lit(0.0), square(r))).alias("dist"), r["label"].alias("label")))
    return met.withColumn("dists", dists).drop("__times", "__energy", "__refs")


def van_rossum(windows: DataFrame, library: DataFrame, win_id: str = "window_id", **options) -> DataFrame:
    """(win_id, label, dist): Van Rossum distance of every window to every reference."""
    return (with_distances(windows, library, **options).select(win_id, F.explode("dists").alias("d"))
            .select(win_id, "d.label", "d.dist"))


def _two_nearest(refs: list, t_steps: int, tau: float):
    """Column function: spike times -> (best_label, best_dist, second_dist) among
    the references (label, times, energy), which come in label order.

    Per reference and feature a table by spike time holds the overlap; the sums
    run feature by feature, as :func:`overlap_energy` adds them."""
    features = max((len(r["times"]) for r in refs if r["times"] is not None), default=0)
    values = kernel_values(t_steps, tau)
    own = np.append(np.diag(values), 0.0)                                   # the last stands for no spike
    table = np.zeros((features, t_steps + 1, len(refs)))
    for n, r in enumerate(refs):
        for i, t in enumerate(r["times"] or []):
            if t >= 0:
                table[i, :t_steps, n] = values[:, t]
    energy = np.array([r["energy"] or 0.0 for r in refs])
    unknown = np.array([r["times"] is None for r in refs], dtype=bool)
    labels = pa.array([r["label"] for r in refs], pa.string())
    sc = SparkSession.active().sparkContext
    shared = sc.broadcast((table, own, energy, unknown, labels))

    def nearest(times: pa.Array) -> pa.Array:
        table, own, energy, unknown, labels = shared.value
        n, refs = len(times), len(labels)
        size = np.where(times.is_null().to_numpy(zero_copy_only=False), 0, np.diff(times.offsets.to_numpy()))
        code = np.full((n, max(int(size.max()) if n else 0, len(table))), -1, dtype=np.int64)
        code[np.arange(code.shape[1])[None, :] < size[:, None]] = times.flatten().to_numpy()
        code[code < 0] = -1
        none = times.is_null().to_numpy(zero_copy_only=False)
        best, first, second = np.zeros(n, np.int64), np.full(n, np.nan), np.full(n, np.nan)
        step = max(1, (1 << 18) // max(1, refs))
        for lo in range(0, n if refs else 0, step):
            part = code[lo:lo + step]
            cross, power = np.zeros((len(part), refs)), np.zeros(len(part))
            for i in range(code.shape[1]):
                power += own[part[:, i]]
                if i < len(table):
                    cross += table[i][part[:, i]]
            square = (power[:, None] + energy - 2.0 * cross) / tau
            square[none[lo:lo + step]] = 0.0
            square[:, unknown] = 0.0
            dist, row = np.sqrt(np.maximum(0.0, square)), np.arange(len(part))
            at = best[lo:lo + step] = dist.argmin(axis=1)                   # the first of equals: the smaller label
            first[lo:lo + step] = dist[row, at]
            dist[row, at] = np.inf
            second[lo:lo + step] = dist.min(axis=1) if refs > 1 else np.nan
        as_double = lambda x, least: pa.array(x, pa.float64(), mask=np.full(n, refs < least))
        return pa.StructArray.from_arrays([labels.take(pa.array(best)) if refs else pa.nulls(n, pa.string()), as_double(first, 1), as_double(second, 2)],
                                          names=["best_label", "best_dist", "second_dist"])

    return F.arrow_udf(nearest, "best_label string, best_dist double, second_dist double")


def nearest_two(windows: DataFrame, library: DataFrame, win_id: str = "window_id", vec: str = "vec", label: str = "label",
                t_steps: int = encode.T, tau: float = encode.TAU, max_bytes: int = 8 << 20) -> DataFrame:
    """The windows with best_label, best_dist and second_dist (ties -> smaller
    label).  A library of up to ``max_bytes`` is broadcast as tables and windows
    are measured in batches; a larger one is met chunk by chunk, keeping two per
    chunk, and merged."""
    packed, chunks = _references(library, vec, label, t_steps, tau, max_bytes)
    if chunks == 1:
        one = packed.first()                                                # at most max_bytes
        udf = _two_nearest(one["__refs"] if one else [], t_steps, tau)
        near = (windows.withColumn("__two", udf(spike_times(vec, t_steps)))
                .join(F.broadcast(packed.select(F.size("__refs").alias("__known"))), how="left"))       # no row: no references
        found = lambda c: F.when(F.col("__known") > 0, F.col(f"__two.{c}")).alias(c)
        return near.select(*windows.columns, found("best_label"), found("best_dist"), found("second_dist"))
    two = F.slice(F.array_sort("dists"), 1, 2)
    near = _all_distances(windows, packed, chunks, vec, t_steps, tau).drop("__chunks").withColumn("dists", two).groupBy("__row").agg(
        *[F.first(c).alias(c) for c in windows.columns], F.flatten(F.collect_list("dists")).alias("dists"))
    near = near.withColumn("__two", two)
    return near.select(*windows.columns, F.get("__two", F.lit(0))["label"].alias("best_label"),
                       F.get("__two", F.lit(0))["dist"].alias("best_dist"), F.get("__two", F.lit(1))["dist"].alias("second_dist"))


def ratio_match(nearest: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Adds ``match`` and ``matched``: the nearest reference when ``best < ratio *
    second``; a single reference has second = infinity and always matches."""
    ok = F.coalesce(F.col("best_dist") < F.lit(ratio) * F.coalesce(F.col("second_dist"), F.lit(float("inf"))), F.lit(False))
    return nearest.withColumns({"match": F.when(ok, F.col("best_label")), "matched": ok})


def sq_l2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def nearest_prototype(windows: DataFrame, protos: DataFrame, win_id: str = "window_id", label: str = "label",
                      vec: str = "vec") -> DataFrame:
    """Nearest prototype by squared L2 (ties -> smaller label)."""
    p = protos.select(F.col(label).alias("__plabel"), F.col(vec).alias("__pvec"))
    pairs = pair_with_library(windows.select(win_id, vec), p)
    d = pairs.select(win_id, F.col("__plabel").alias("proto"), sq_l2(F.col(vec), F.col("__pvec")).alias("d2"))
    best = d.groupBy(win_id).agg(F.min(F.struct("d2", "proto")).alias("b"))
    return best.select(win_id, F.col("b.proto").alias("pred"), F.col("b.d2").alias("d2"))


def holdout_split(df: DataFrame, label: str = "label", order: str = "window_id", block_size: int = 1 << 16) -> DataFrame:
    """Per label, rows 0, 2, 4, ... (in ``order``) train, the others test."""
    blk = F.floor(F.col(order) / F.lit(block_size)).cast("bigint")
    n = seq_number(df, [label], [order], blk, "__rn")
    return n.withColumn("split", F.when(F.pmod(F.col("__rn") - 1, F.lit(2)) == 0, F.lit("train"))
                        .otherwise(F.lit("test"))).drop("__rn")


def hash_split(df: DataFrame, key_cols, seed: int, test_fraction: float = 0.15) -> DataFrame:
    """Stable split by a keyed uniform: ``u < test_fraction`` -> test."""
    from eventlake.functions.rng import hash_uniform
    u = hash_uniform(seed, *[F.col(c) for c in key_cols])
    return df.withColumn("split", F.when(u < F.lit(test_fraction), F.lit("test")).otherwise(F.lit("train")))


def spread_sample(df: DataFrame, key_cols, k: int, seed: int, label: str | None = None) -> DataFrame:
    """Exactly ``k`` rows (all, if fewer) spread over the whole input, or ``k``
    per ``label``: the smallest keyed uniforms, so the order of the source does
    not matter.  ``k`` is the feature; the limit is applied in each task first."""
    from eventlake.functions.rng import hash_uniform
    keyed = df.withColumn("__u", hash_uniform(seed, *[F.col(c) for c in key_cols]))
    if label is None:
        return keyed.orderBy("__u", *key_cols).limit(int(k)).drop("__u")
    w = Window.partitionBy(label).orderBy("__u", *key_cols)
    return keyed.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= int(k)).drop("__u", "__n")


def novelty_gate(nearest: DataFrame, is_known: str = "known", d: str = "best_dist") -> DataFrame:
    """Gate at the midpoint ``(max known + min novel) / 2`` -> one row."""
    return nearest.agg(F.max(F.when(F.col(is_known), F.col(d))).alias("max_known"),
                       F.min(F.when(~F.col(is_known), F.col(d))).alias("min_novel")).select(
        "max_known", "min_novel", ((F.col("max_known") + F.col("min_novel")) / 2.0).alias("gate"))


def hybrid_match(nearest: DataFrame, gate: DataFrame, learned: str = "learned", d: str = "best_dist") -> DataFrame:
    """Gate first, then the learned label: adds ``hybrid``, null for a window
    farther from every reference than the one-row ``gate``."""
    return (nearest.join(F.broadcast(gate.select(F.col("gate").alias("__gate"))), how="cross")
            .withColumn("hybrid", F.when(F.col(d) <= F.col("__gate"), F.col(learned))).drop("__gate"))


def match_stats(results: DataFrame, truth: str = "true_label", pred: str = "match") -> DataFrame:
    """events, matched, correct, rejected, labeled; accuracy over labeled,
    rejection rate over unlabeled (novel) windows."""
    lab = F.col(truth).isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col(pred).isNotNull()).alias("matched"),
        F.count_if(lab & (F.col(pred) == F.col(truth))).alias("correct"),
        F.count_if(F.col(pred).isNull()).alias("rejected"),
        F.count_if(lab).alias("labeled"),
        F.count_if(~lab & F.col(pred).isNull()).alias("novel_rejected"),
        F.count_if(~lab).alias("novel"),
    ).select("*", F.try_divide(F.col("correct"), F.col("labeled")).alias("accuracy"),
             F.try_divide(F.col("novel_rejected"), F.col("novel")).alias("rejection_rate"))


def enroll(library: DataFrame, enrollments: DataFrame, label: str = "label") -> DataFrame:
    """Union the library with new enrollments; per (label, feature) the
    highest version wins (one reference per label, replaced on re-enroll)."""
    u = library.unionByName(enrollments)
    keys = [label] + [c for c in ("i",) if c in u.columns]
    return u.groupBy(*keys).agg(F.max_by("v", "version").alias("v"), F.max("version").alias("version"))
