"""Signal-window queries over `embeddings`: array transforms, encoders, matching."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventlake.functions.rng import hash_uniform, sql_hash_uniform
from eventlake.operators import encode, match
from eventlake.plans.registry import query
from eventlake.sources import adapters
from eventlake.sources.tables import table

N, T, TAU, FLOOR = encode.N, encode.T, encode.TAU, encode.FLOOR
RESIZE_N = 72
BURST = 3
POISSON_SEED = 42
POISSON_RATE = 0.5
HASH_SEED = 7
KNOWN_LABELS = [str(i) for i in range(7)]   # library labels; the rest are novel
Q = math.exp(-2.0 / TAU)

# ---- shared SQL fragments (DuckDB)
RAW = ("SELECT vec_id AS window_id, CAST(label AS VARCHAR) AS label, "
       "list_resize(CAST(embedding AS DOUBLE[]), {n}, 0.0) AS l FROM embeddings")
NORM_SQL = (f"norm AS (SELECT window_id, label, i, CASE WHEN hi - lo > 1e-9 THEN (v - lo) / (hi - lo) ELSE 0.0 END AS v "
            f"FROM (SELECT window_id, label, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS i, "
            f"list_min(l) AS lo, list_max(l) AS hi FROM ({RAW.format(n=N)})))")
SPLIT_SQL = ("split AS (SELECT window_id, label, CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY window_id) - 1) "
             "% 2 = 0 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT window_id, label FROM norm))")
PROTO_SQL = ("proto AS (SELECT n.label, n.i, avg(n.v) AS v FROM norm n JOIN split s USING (window_id) "
             "WHERE s.split = 'train' GROUP BY n.label, n.i)")


def _k(a, b):
    return (f"(exp(-abs({a} - {b}) / {TAU!r}) * (1.0 - pow({Q!r}, {T} - greatest({a}, {b}))) / {1.0 - Q!r})")


def _lat(src, key, where=""):
    return (f"SELECT {key}, CAST(round_even((1.0 - v) * {T - 1}, 0) AS INTEGER) AS t, CAST(i AS INTEGER) AS i "
            f"FROM {src} WHERE v >= {FLOOR} {where}")


def _vr_sql(lib_where="", extra_ctes="", win_src="norm", tw_src=None):
    """CTEs up to `dist` (window_id, label, dist) for test windows vs the library.
    ``win_src``/``tw_src`` swap in other window rows (e.g. noisy copies)."""
    tw = tw_src or "SELECT window_id, label AS true_label FROM split WHERE split = 'test'"
    return (f"WITH {NORM_SQL}, {SPLIT_SQL}, {PROTO_SQL}, {extra_ctes}"
            f"lib AS (SELECT DISTINCT label FROM proto WHERE 1=1 {lib_where}), "
            f"tw AS ({tw}), "
            f"we AS ({_lat(win_src, 'window_id', 'AND window_id IN (SELECT window_id FROM tw)')}), "
            f"re AS ({_lat('proto', 'label', 'AND label IN (SELECT label FROM lib)')}), "
            f"sw AS (SELECT tw.window_id, coalesce(sum({_k('we.t', 'we.t')}), 0.0) AS sw FROM tw "
            f"LEFT JOIN we USING (window_id) GROUP BY tw.window_id), "
            f"sr AS (SELECT lib.label, coalesce(sum({_k('re.t', 're.t')}), 0.0) AS sr FROM lib "
            f"LEFT JOIN re USING (label) GROUP BY lib.label), "
            f"x AS (SELECT we.window_id, re.label, sum({_k('we.t', 're.t')}) AS x FROM we JOIN re USING (i) "
            f"GROUP BY ALL), "
            f"dist AS (SELECT sw.window_id, sr.label, sqrt(greatest(0.0, (sw + sr - 2.0 * coalesce(x.x, 0.0)) / {TAU!r})) "
            f"AS dist FROM sw CROSS JOIN sr LEFT JOIN x ON x.window_id = sw.window_id AND x.label = sr.label)")


# ---- Spark side
def _signals(spark, sf):
    return adapters.signals(table(spark, sf, "embeddings"))


def _norm(spark, sf):
    return encode.normalized(_signals(spark, sf), "vec", "vec")


def _rows(df, vec="vec", val="v"):
    return df.select("window_id", F.posexplode_outer(vec).alias("i", val)).select(
        "window_id", F.col("i").cast("bigint").alias("i"), val)


def _split(spark, sf):
    return match.holdout_split(_norm(spark, sf))


def _library(spark, sf, labels=None):
    tr = _split(spark, sf).filter(F.col("split") == "train")
    if labels is not None:
        tr = tr.filter(F.col("label").isin(labels))
    return match.prototypes(tr)


def _test(spark, sf):
    return _split(spark, sf).filter(F.col("split") == "test")


def _nearest(spark, sf, labels=None):
    return match.nearest_two(_test(spark, sf), _library(spark, sf, labels))


@query("normalize", f"WITH {NORM_SQL} SELECT window_id, i, v FROM norm")
def q_normalize(spark, sf):
    return _rows(_norm(spark, sf))


@query("resize", f"SELECT window_id, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS i FROM ({RAW.format(n=RESIZE_N)})")
def q_resize(spark, sf):
    return _rows(_signals(spark, sf).select("window_id", encode.resize("vec", RESIZE_N).alias("vec")))


@query("binarize", f"WITH {NORM_SQL} SELECT window_id, i, CAST(CASE WHEN v >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS b "
       "FROM norm")
def q_binarize(spark, sf):
    return _rows(_norm(spark, sf).select("window_id", encode.binarize("vec").alias("vec")), val="b")


@query("latency_encode", f"WITH {NORM_SQL} {_lat('norm', 'window_id')}")
def q_latency(spark, sf):
    return encode.latency_events(_norm(spark, sf))


@query("ttfs_encode", f"WITH {NORM_SQL} SELECT window_id, CAST(trunc((1.0 - v) * {T - 1}) AS INTEGER) AS t, "
       f"CAST(i AS INTEGER) AS i FROM norm WHERE v >= {FLOOR}")
def q_ttfs(spark, sf):
    return encode.ttfs_events(_norm(spark, sf))


@query("burst_encode",
       f"WITH {NORM_SQL}, b AS (SELECT window_id, CAST(i AS INTEGER) AS i, "
       f"CAST(round_even((1.0 - v) * {T - 1}, 0) AS INTEGER) AS t0, "
       f"greatest(1, CAST(round_even(v * {BURST}, 0) AS INTEGER)) AS nb FROM norm WHERE v >= {FLOOR}) "
       f"SELECT window_id, t, i FROM (SELECT window_id, i, unnest(range(t0, t0 + nb)) AS t FROM b) WHERE t < {T}")
def q_burst(spark, sf):
    return encode.burst_events(_norm(spark, sf), BURST)


@query("poisson_encode",
       f"WITH {NORM_SQL}, g AS (SELECT window_id, i, v, unnest(range(0, {T})) AS t FROM norm WHERE v >= {FLOOR}) "
       f"SELECT window_id, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i FROM g "
       f"WHERE {sql_hash_uniform(POISSON_SEED, 'window_id', 'i', 't')} < v * {POISSON_RATE}")
def q_poisson(spark, sf):
    return encode.poisson_events(_norm(spark, sf), POISSON_SEED, POISSON_RATE)


@query("binary_rate_encode",
       f"WITH {NORM_SQL}, g AS (SELECT window_id, i, v, unnest(range(0, {T})) AS t FROM norm) "
       f"SELECT window_id, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i FROM g "
       f"WHERE {sql_hash_uniform(POISSON_SEED, 'window_id', 'i', 't')} < CASE WHEN v >= 0.5 THEN 0.9 ELSE 0.05 END")
def q_binary_rate(spark, sf):
    lit = _norm(spark, sf).select("window_id", encode.binarize("vec").alias("bits"))
    return encode.binary_rate_events(lit, POISSON_SEED)


@query("decay_trace",
       f"WITH {NORM_SQL}, e AS ({_lat('norm', 'window_id')}), "
       f"g AS (SELECT window_id, i, t AS s, unnest(range(t, {T})) AS t FROM e) "
       f"SELECT window_id, i, CAST(t AS INTEGER) AS t, round(exp(-(t - s) / {TAU!r}), 9) AS w FROM g")
def q_decay(spark, sf):
    ev = encode.latency_events(_norm(spark, sf))
    return encode.decay_trace(ev).withColumn("w", F.round("w", 9))


@query("holdout_split", f"WITH {NORM_SQL}, {SPLIT_SQL} SELECT window_id, label, split FROM split")
def q_holdout(spark, sf):
    return _split(spark, sf).select("window_id", "label", "split")


@query("hash_split", f"SELECT vec_id AS window_id, CASE WHEN {sql_hash_uniform(HASH_SEED, 'vec_id')} < 0.15 "
       "THEN 'test' ELSE 'train' END AS split FROM embeddings")
def q_hash_split(spark, sf):
    return match.hash_split(_signals(spark, sf), ["window_id"], HASH_SEED).select("window_id", "split")


SPREAD_K = 40       # rows of a spread sample, and per label


@query("spread_sample", f"SELECT vec_id AS window_id FROM embeddings ORDER BY {sql_hash_uniform(HASH_SEED, 'vec_id')}, vec_id LIMIT {SPREAD_K}")
def q_spread(spark, sf):
    return match.spread_sample(_signals(spark, sf), ["window_id"], SPREAD_K, HASH_SEED).select("window_id")


@query("spread_sample_per_label", "SELECT window_id, label FROM (SELECT vec_id AS window_id, CAST(label AS VARCHAR) AS label, row_number() OVER "
       f"(PARTITION BY label ORDER BY {sql_hash_uniform(HASH_SEED, 'vec_id')}, vec_id) AS n FROM embeddings) WHERE n <= {SPREAD_K}")
def q_spread_label(spark, sf):
    return match.spread_sample(_signals(spark, sf), ["window_id"], SPREAD_K, HASH_SEED, "label").select("window_id", "label")


@query("prototypes", f"WITH {NORM_SQL}, {SPLIT_SQL}, {PROTO_SQL} SELECT label, i, round(v, 6) AS v FROM proto")
def q_prototypes(spark, sf):
    lib = _library(spark, sf)
    return lib.select("label", F.posexplode_outer("vec").alias("i", "v")).select(
        "label", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("van_rossum_pairs", f"{_vr_sql()} SELECT window_id, label, round(dist, 6) AS dist FROM dist")
def q_vr_pairs(spark, sf):
    d = match.van_rossum(_test(spark, sf).drop("label"), _library(spark, sf))
    return d.select("window_id", "label", F.round("dist", 6).alias("dist"))


_BEST2 = ("b2 AS (SELECT window_id, max(CASE WHEN rn = 1 THEN label END) AS best_label, "
          "max(CASE WHEN rn = 1 THEN dist END) AS best_dist, max(CASE WHEN rn = 2 THEN dist END) AS second_dist "
          "FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY dist, label) AS rn FROM dist) "
          "WHERE rn <= 2 GROUP BY window_id), "
          f"m AS (SELECT *, best_dist < {match.RATIO} * coalesce(second_dist, 'inf'::DOUBLE) AS matched FROM b2)")


@query("template_match",
       f"{_vr_sql()}, {_BEST2} SELECT window_id, CASE WHEN matched THEN best_label END AS \"match\", best_label, "
       "round(best_dist, 6) AS best_dist, round(second_dist, 6) AS second_dist, matched FROM m")
def q_template_match(spark, sf):
    r = match.ratio_match(_nearest(spark, sf))
    return r.select("window_id", "match", "best_label", F.round("best_dist", 6).alias("best_dist"),
                    F.round("second_dist", 6).alias("second_dist"), "matched")


@query("match_stats",
       f"{_vr_sql(' AND label IN (' + ', '.join(repr(x) for x in KNOWN_LABELS) + ')')}, {_BEST2}, "
       "r AS (SELECT m.window_id, CASE WHEN matched THEN best_label END AS mt, "
       f"CASE WHEN tw.true_label IN ({', '.join(repr(x) for x in KNOWN_LABELS)}) THEN tw.true_label END AS tl "
       "FROM m JOIN tw USING (window_id)) "
       "SELECT count(*) AS events, count(mt) AS matched, count(*) FILTER (WHERE tl IS NOT NULL AND mt = tl) AS correct, "
       "count(*) FILTER (WHERE mt IS NULL) AS rejected, count(tl) AS labeled, "
       "count(*) FILTER (WHERE tl IS NULL AND mt IS NULL) AS novel_rejected, count(*) FILTER (WHERE tl IS NULL) AS novel, "
       "CASE WHEN count(tl) = 0 THEN NULL ELSE count(*) FILTER (WHERE tl IS NOT NULL AND mt = tl) / count(tl) END "
       "AS accuracy, CASE WHEN count(*) FILTER (WHERE tl IS NULL) = 0 THEN NULL ELSE "
       "count(*) FILTER (WHERE tl IS NULL AND mt IS NULL) / count(*) FILTER (WHERE tl IS NULL) END AS rejection_rate "
       "FROM r")
def q_match_stats(spark, sf):
    r = match.ratio_match(_nearest(spark, sf, KNOWN_LABELS))
    return match.match_stats(r.withColumn("true_label", F.when(F.col("label").isin(KNOWN_LABELS), F.col("label"))))


@query("novelty_gate",
       f"{_vr_sql(' AND label IN (' + ', '.join(repr(x) for x in KNOWN_LABELS) + ')')}, "
       "nd AS (SELECT d.window_id, min(dist) AS best_dist, "
       f"any_value(tw.true_label) IN ({', '.join(repr(x) for x in KNOWN_LABELS)}) AS known "
       "FROM dist d JOIN tw USING (window_id) GROUP BY d.window_id) "
       "SELECT round(max(best_dist) FILTER (WHERE known), 6) AS max_known, "
       "round(min(best_dist) FILTER (WHERE NOT known), 6) AS min_novel, "
       "round((max(best_dist) FILTER (WHERE known) + min(best_dist) FILTER (WHERE NOT known)) / 2.0, 6) AS gate FROM nd")
def q_novelty_gate(spark, sf):
    g = match.novelty_gate(_nearest(spark, sf, KNOWN_LABELS).withColumn("known", F.col("label").isin(KNOWN_LABELS)))
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


@query("nearest_prototype",
       f"WITH {NORM_SQL}, {SPLIT_SQL}, {PROTO_SQL}, "
       "d AS (SELECT n.window_id, p.label AS proto, sum((n.v - p.v) * (n.v - p.v)) AS d2 FROM norm n "
       "JOIN split s ON s.window_id = n.window_id AND s.split = 'test' JOIN proto p ON p.i = n.i GROUP BY ALL) "
       "SELECT window_id, pred, round(d2, 6) AS d2 FROM (SELECT window_id, proto AS pred, d2, "
       "row_number() OVER (PARTITION BY window_id ORDER BY d2, proto) AS rn FROM d) WHERE rn = 1")
def q_nearest_proto(spark, sf):
    sp = _split(spark, sf)
    test = sp.filter(F.col("split") == "test").select("window_id", "vec")
    r = match.nearest_prototype(test, _library(spark, sf))
    return r.select("window_id", "pred", F.round("d2", 6).alias("d2"))


# ---- discovering unknown signals (F12, F13)
def _unknowns(spark, sf):
    """Rejected windows; a stream per capture of 1024 consecutive windows."""
    r = match.ratio_match(_nearest(spark, sf, KNOWN_LABELS)).filter(F.col("match").isNull())
    capture = F.concat(F.lit("capture-"), F.floor(F.col("window_id") / F.lit(1024)).cast("string"))
    return r.select(capture.alias("stream_id"), F.col("window_id").alias("seq"), F.col("best_dist").alias("dist"), "vec")


def _clusters(spark, sf):
    from eventlake.operators import cluster
    lib = _library(spark, sf, KNOWN_LABELS)
    radius = cluster.auto_radius(lib).first()["radius"]
    unk = _unknowns(spark, sf)
    return unk, cluster.leader_clusters(unk, radius)


@query("cluster_leader", None, note="order-dependent leader clustering: ordered fold per stream")
def q_cluster_leader(spark, sf):
    _, a = _clusters(spark, sf)
    return a


@query("promote", None, note="promotion of clusters with enough support")
def q_promote(spark, sf):
    from eventlake.operators import cluster
    unk, a = _clusters(spark, sf)
    summ = cluster.cluster_summary(unk, a)
    lib = _library(spark, sf, KNOWN_LABELS)
    return cluster.promote(summ, lib.select("label"), name_largest="WAVE").select("stream_id", "label", "size")


@query("discover", None, note="unknowns recorded, clustered, promoted, joined to the library; consumed unknowns marked")
def q_discover(spark, sf):
    from eventlake.operators import cluster
    from eventlake.sources import lake
    from eventlake.streaming.common import run_dir
    base = run_dir(spark, "discover")
    lib = _library(spark, sf, KNOWN_LABELS)
    lake.write_unknowns(_unknowns(spark, sf), f"{base}/unknowns")
    grown = cluster.close_loop(spark, base, lib)
    again = cluster.close_loop(spark, base, grown)          # everything is consumed: nothing new
    return again.select("label", F.size("vec").alias("n"))


# ---- matcher noise sweep (F30): all noise levels in one job
NOISE_LEVELS = [0.0, 0.1, 0.2, 0.4]
NOISE_SEED = 13


_LEVELS_SQL = ", ".join(f"({g}, CAST({x!r} AS DOUBLE))" for g, x in enumerate(NOISE_LEVELS))
_KNOWN_SQL = ", ".join(repr(x) for x in KNOWN_LABELS)
NOISE_SQL = (_vr_sql(f" AND label IN ({_KNOWN_SQL})",
                     extra_ctes=(f"lv AS (SELECT * FROM (VALUES {_LEVELS_SQL}) v(level, noise)), "
                                 "tst AS (SELECT n.window_id, n.label, n.i, n.v FROM norm n JOIN split s USING (window_id) "
                                 "WHERE s.split = 'test'), "
                                 "nz AS (SELECT tst.window_id * 8 + lv.level AS window_id, tst.label, lv.noise, tst.i, "
                                 f"least(1.0, greatest(0.0, tst.v + ({sql_hash_uniform(NOISE_SEED, 'tst.window_id', 'tst.i', 'lv.level')}"
                                 " * 2 - 1) * lv.noise)) AS v FROM tst, lv), "),
                     win_src="nz",
                     tw_src="SELECT DISTINCT window_id, label AS true_label, noise FROM nz")
             + f", {_BEST2}, r AS (SELECT m.window_id, tw.noise, CASE WHEN matched THEN best_label END AS mt, "
             f"CASE WHEN tw.true_label IN ({_KNOWN_SQL}) THEN tw.true_label END AS tl FROM m JOIN tw USING (window_id)) "
             "SELECT noise, count(*) AS events, count(mt) AS matched, "
             "count(*) FILTER (WHERE tl IS NOT NULL AND mt = tl) AS correct, count(tl) AS labeled, "
             "count(*) FILTER (WHERE tl IS NULL AND mt IS NULL) AS novel_rejected, count(*) FILTER (WHERE tl IS NULL) AS novel, "
             "CASE WHEN count(tl) = 0 THEN NULL ELSE count(*) FILTER (WHERE tl IS NOT NULL AND mt = tl) / count(tl) END "
             "AS accuracy, CASE WHEN count(*) FILTER (WHERE tl IS NULL) = 0 THEN NULL ELSE "
             "count(*) FILTER (WHERE tl IS NULL AND mt IS NULL) / count(*) FILTER (WHERE tl IS NULL) END AS rejection_rate "
             "FROM r GROUP BY noise")


@query("noise_sweep", NOISE_SQL, note="grid of noise levels x ratio-test matcher, one job")
def q_noise_sweep(spark, sf):
    from eventlake.functions.rng import hash_uniform
    sp = _split(spark, sf)
    test = sp.filter(F.col("split") == "test")
    lib = _library(spark, sf, KNOWN_LABELS)
    levels = spark.createDataFrame([(g, s) for g, s in enumerate(NOISE_LEVELS)], "level int, noise double")
    grid = test.join(F.broadcast(levels), how="cross")       # fixed 4-row parameter table
    jit = F.transform("vec", lambda v, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + (
        hash_uniform(NOISE_SEED, F.col("window_id"), i, F.col("level")) * 2 - 1) * F.col("noise"))))
    noisy = grid.select((F.col("window_id") * 8 + F.col("level")).alias("window_id"), "level", "noise", "label",
                        jit.alias("vec"))
    r = match.ratio_match(match.nearest_two(noisy, lib)).withColumn(
        "true_label", F.when(F.col("label").isin(KNOWN_LABELS), F.col("label")))
    out = r.groupBy("noise").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("match").isNotNull()).alias("matched"),
        F.count_if(F.col("true_label").isNotNull() & (F.col("match") == F.col("true_label"))).alias("correct"),
        F.count_if(F.col("true_label").isNotNull()).alias("labeled"),
        F.count_if(F.col("true_label").isNull() & F.col("match").isNull()).alias("novel_rejected"),
        F.count_if(F.col("true_label").isNull()).alias("novel"))
    return out.select("*", F.try_divide(F.col("correct"), F.col("labeled")).alias("accuracy"),
                      F.try_divide(F.col("novel_rejected"), F.col("novel")).alias("rejection_rate"))


# ---- hybrid matcher (F11) and the three matchers over the noise levels (F30)
def _matchers(spark, sf, windows):
    """Template, learned and hybrid label of windows (window_id, label, vec, ...)."""
    from eventlake.operators import readout
    known = _split(spark, sf).filter(F.col("label").isin(KNOWN_LABELS))
    lib = _library(spark, sf, KNOWN_LABELS)
    gate = match.novelty_gate(match.nearest_two(_test(spark, sf), lib).withColumn("known", F.col("label").isin(KNOWN_LABELS)))
    near = match.ratio_match(match.nearest_two(windows, lib)).withColumnRenamed("match", "template")
    learned = readout.learned_labeller(known.filter(F.col("split") == "train").select("label", "vec"))
    return match.hybrid_match(learned(near), gate)


@query("hybrid_match", None, note="novelty gate, then the learned readout's label (Spark ML fit)")
def q_hybrid(spark, sf):
    return _matchers(spark, sf, _test(spark, sf)).select("window_id", "label", "template", "learned", "hybrid", F.round("best_dist", 6).alias("best_dist"))


@query("noise_sweep_matchers", None, note="accuracy on known and rejection on novel windows of the three matchers by noise level")
def q_noise_matchers(spark, sf):
    from eventlake.functions.rng import hash_uniform
    levels = spark.createDataFrame([(g, s) for g, s in enumerate(NOISE_LEVELS)], "level int, noise double")
    grid = _test(spark, sf).join(F.broadcast(levels), how="cross")       # fixed 4-row parameter table
    jit = F.transform("vec", lambda v, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + (
        hash_uniform(NOISE_SEED, F.col("window_id"), i, F.col("level")) * 2 - 1) * F.col("noise"))))
    m = _matchers(spark, sf, grid.select((F.col("window_id") * 8 + F.col("level")).alias("window_id"), "noise", "label", jit.alias("vec")))
    known = F.col("label").isin(KNOWN_LABELS)
    one = m.select("noise", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("matcher"), F.col(k).alias("says")) for k in ("template", "learned", "hybrid")])).alias("r"))
    return one.groupBy("noise", "r.matcher").agg(
        F.avg(F.when(known, F.coalesce(F.col("r.says") == F.col("label"), F.lit(False)).cast("double"))).alias("accuracy"),
        F.avg(F.when(~known, F.col("r.says").isNull().cast("double"))).alias("rejection_rate"))


# ---- recurring signals by the radius graph (F12, scalable form)
RADIUS = 2.4
REPEATS, JITTER, JITTER_SEED = 3, 0.03, 19       # every window comes three times, each time with more jitter
_JITTERED = (f"least(1.0, greatest(0.0, v + {JITTER!r} * c * ({sql_hash_uniform(JITTER_SEED, 'window_id', 'c', 'i')} - 0.5)))")
RADIUS_SQL = (f"WITH RECURSIVE {NORM_SQL}, rep AS (SELECT window_id * {REPEATS} + c AS window_id, i, {_JITTERED} AS v "
              f"FROM norm, (SELECT unnest(range({REPEATS})) AS c)), "
              f"w AS (SELECT DISTINCT window_id FROM rep), e AS ({_lat('rep', 'window_id')}), "
              f"s AS (SELECT w.window_id, coalesce(sum({_k('e.t', 'e.t')}), 0.0) AS s FROM w LEFT JOIN e USING (window_id) GROUP BY ALL), "
              f"x AS (SELECT a.window_id AS a, b.window_id AS b, sum({_k('a.t', 'b.t')}) AS x FROM e a JOIN e b USING (i) "
              "WHERE a.window_id < b.window_id GROUP BY ALL), "
              "near AS (SELECT p.window_id AS a, q.window_id AS b FROM s p JOIN s q ON p.window_id < q.window_id "
              "LEFT JOIN x ON x.a = p.window_id AND x.b = q.window_id "
              f"WHERE sqrt(greatest(0.0, (p.s + q.s - 2.0 * coalesce(x.x, 0.0)) / {TAU!r})) <= {RADIUS}), "
              "link AS (SELECT a, b FROM near UNION SELECT b, a FROM near), "
              "reach(node, root) AS (SELECT window_id, window_id FROM w UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node), "
              "c AS (SELECT node, min(root) AS cluster_id FROM reach GROUP BY node) "
              "SELECT node AS window_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM c")


@query("cluster_radius_graph", RADIUS_SQL, note="components of the radius graph by locality-sensitive hashing")
def q_cluster_radius_graph(spark, sf):
    from eventlake.operators import radius
    each = _norm(spark, sf).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    moved = F.transform("vec", lambda v, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + F.lit(JITTER) * F.col("c") * (
        hash_uniform(JITTER_SEED, F.col("window_id"), F.col("c"), i) - F.lit(0.5)))))
    jittered = each.withColumn("vec", moved)         # before window_id changes its meaning
    return radius.radius_clusters(jittered.select((F.col("window_id") * REPEATS + F.col("c")).alias("window_id"), "vec"), RADIUS)
