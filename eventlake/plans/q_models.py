"""Event camera, readout/routing, associative recall and graph queries."""

from __future__ import annotations

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.functions.rng import hash_uniform, sql_hash_uniform
from eventlake.operators import encode, frames, graph, memory, readout
from eventlake.plans.q_signals import NORM_SQL, POISSON_RATE, POISSON_SEED, _norm
from eventlake.plans.registry import query
from eventlake.sources import adapters
from eventlake.sources.tables import table

# ------------------------------------------------------------ event camera
FLAG_CASE = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"
CAM_SQL = (f"cam AS (SELECT l_orderkey * 4 + {FLAG_CASE} AS sample_id, CAST({FLAG_CASE} AS INTEGER) AS label, "
           "CAST(l_partkey % 34 AS INTEGER) AS x, CAST(l_suppkey % 34 AS INTEGER) AS y, "
           "(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) * 1000 + l_linenumber * 37) % 300000 AS t, "
           "CAST(l_linenumber % 2 AS INTEGER) AS p FROM lineitem)")
FR_SQL = (f"fr AS (SELECT sample_id, label, CAST(least({frames.T_BINS - 1}, (t * {frames.T_BINS}) // {frames.DUR}) AS INTEGER) "
          "AS frame, CAST((p % 2) * 1156 + y * 34 + x AS INTEGER) AS idx, CAST(least(count(*), 255) AS INTEGER) AS cnt "
          "FROM cam WHERE t >= 0 GROUP BY ALL)")
RV_SQL = f"rv AS (SELECT sample_id, label, idx, sum(cnt) / {float(frames.T_BINS)} AS rate FROM fr GROUP BY ALL)"
CAM_SEED = 3
SPLIT_SQL = (f"sp AS (SELECT DISTINCT sample_id, CASE WHEN {sql_hash_uniform(CAM_SEED, 'sample_id')} < 0.3 "
             "THEN 'test' ELSE 'train' END AS split FROM rv)")


def _camera(spark, sf):
    return adapters.camera(table(spark, sf, "lineitem"))


def _rates(spark, sf):
    return frames.rate_vectors(frames.frames(_camera(spark, sf)))


def _cam_split(rates):
    u = hash_uniform(CAM_SEED, F.col("sample_id"))
    return rates.withColumn("split", F.when(u < F.lit(0.3), F.lit("test")).otherwise(F.lit("train")))


@query("camera_frames", f"WITH {CAM_SQL}, {FR_SQL} SELECT sample_id, frame, idx, cnt FROM fr")
def q_frames(spark, sf):
    return frames.frames(_camera(spark, sf)).select("sample_id", "frame", "idx", "cnt")


@query("rate_vectors", f"WITH {CAM_SQL}, {FR_SQL}, {RV_SQL} SELECT sample_id, idx, rate FROM rv")
def q_rates(spark, sf):
    return _rates(spark, sf).select("sample_id", "idx", "rate")


@query("sparsity", f"WITH {CAM_SQL}, {FR_SQL}, {RV_SQL} SELECT sample_id, "
       f"count(*) FILTER (WHERE rate > 0) / {float(frames.P * frames.H * frames.W)} AS active_fraction FROM rv GROUP BY ALL")
def q_sparsity(spark, sf):
    return frames.sparsity(_rates(spark, sf))


_CLS_SQL = (f"WITH {CAM_SQL}, {FR_SQL}, {RV_SQL}, {SPLIT_SQL}, "
            "tr AS (SELECT rv.* FROM rv JOIN sp USING (sample_id) WHERE split = 'train'), "
            "te AS (SELECT rv.* FROM rv JOIN sp USING (sample_id) WHERE split = 'test'), "
            "n AS (SELECT label, count(DISTINCT sample_id) AS n FROM tr GROUP BY ALL), "
            "pr AS (SELECT label, idx, sum(rate) / any_value(n.n) AS v FROM tr JOIN n USING (label) GROUP BY ALL), "
            "xx AS (SELECT sample_id, sum(rate * rate) AS xx FROM te GROUP BY ALL), "
            "pp AS (SELECT label AS plabel, sum(v * v) AS pp FROM pr GROUP BY ALL), "
            "dt AS (SELECT te.sample_id, pr.label AS plabel, sum(te.rate * pr.v) AS xp FROM te JOIN pr USING (idx) GROUP BY ALL), "
            "d AS (SELECT xx.sample_id, pp.plabel, xx.xx + pp.pp - 2.0 * coalesce(dt.xp, 0.0) AS d2 FROM xx CROSS JOIN pp "
            "LEFT JOIN dt ON dt.sample_id = xx.sample_id AND dt.plabel = pp.plabel), "
            "best AS (SELECT sample_id, plabel AS pred, d2 FROM (SELECT *, row_number() OVER (PARTITION BY sample_id "
            "ORDER BY d2, plabel) AS rk FROM d) WHERE rk = 1)")


def _classified(spark, sf):
    r = _cam_split(_rates(spark, sf))
    protos = frames.sparse_prototypes(r.filter(F.col("split") == "train"))
    test = r.filter(F.col("split") == "test")
    return frames.classify_sparse(test, protos), test


@query("camera_classify", f"{_CLS_SQL} SELECT sample_id, pred, round(d2, 6) AS d2 FROM best")
def q_cam_classify(spark, sf):
    c, _ = _classified(spark, sf)
    return c.select("sample_id", "pred", F.round("d2", 6).alias("d2"))


@query("camera_accuracy",
       f"{_CLS_SQL}, lab AS (SELECT DISTINCT sample_id, label FROM te) SELECT count(*) AS n_test, "
       "count(*) FILTER (WHERE pred = label) AS correct, count(*) FILTER (WHERE pred = label) / count(*) AS accuracy "
       "FROM best JOIN lab USING (sample_id)")
def q_cam_accuracy(spark, sf):
    c, test = _classified(spark, sf)
    lab = test.select("sample_id", "label").distinct()
    return c.join(lab, "sample_id").agg(F.count(F.lit(1)).alias("n_test"),
                                        F.count_if(F.col("pred") == F.col("label")).alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("n_test"))


# ------------------------------------------------------------ readout / routing
C = 5
N = encode.N
T = encode.T
FRAC = 0.55


def _w_sql(n_classes, n_experts=None, salt=0):
    if n_experts:
        return (f"SELECT CAST(e AS INTEGER) AS expert, CAST(c AS INTEGER) AS class, CAST(i AS INTEGER) AS i, "
                f"((c * 7 + i * 13 + e * 5 + {salt}) % 11 - 5) / 4.0 AS w FROM range(0, {n_experts}) a(e), "
                f"range(0, {n_classes}) b(c), range(0, {N}) d(i)")
    return (f"SELECT CAST(c AS INTEGER) AS class, CAST(i AS INTEGER) AS i, ((c * 7 + i * 13 + {salt}) % 11 - 5) / 4.0 AS w "
            f"FROM range(0, {n_classes}) b(c), range(0, {N}) d(i)")


POIS_SQL = (f"g AS (SELECT window_id, i, v, unnest(range(0, {T})) AS t FROM norm WHERE v >= {encode.FLOOR}), "
            f"pe AS (SELECT window_id, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i FROM g "
            f"WHERE {sql_hash_uniform(POISSON_SEED, 'window_id', 'i', 't')} < v * {POISSON_RATE}), "
            "cnt AS (SELECT window_id, i, count(*) AS n FROM pe GROUP BY ALL)")


def _counts(spark, sf):
    return readout.spike_counts(encode.poisson_events(_norm(spark, sf), POISSON_SEED, POISSON_RATE))


@query("readout_infer",
       f"WITH {NORM_SQL}, {POIS_SQL}, W AS ({_w_sql(C)}), cur AS (SELECT window_id, class, sum(n * w) AS current "
       "FROM cnt JOIN W USING (i) GROUP BY ALL) SELECT window_id, pred, current FROM (SELECT window_id, class AS pred, "
       "current, row_number() OVER (PARTITION BY window_id ORDER BY current DESC, class) AS rk FROM cur) WHERE rk = 1")
def q_readout(spark, sf):
    w = readout.weight_table(spark, C, N)
    return readout.readout(encode.poisson_events(_norm(spark, sf), POISSON_SEED, POISSON_RATE), w).withColumnRenamed(
        "current", "current")


TTFS_SQL = (f"te AS (SELECT window_id, CAST(trunc((1.0 - v) * {T - 1}) AS INTEGER) AS t, CAST(i AS INTEGER) AS i "
            f"FROM norm WHERE v >= {encode.FLOOR}), W AS ({_w_sql(C)}), "
            "fin AS (SELECT window_id, class, sum(w) AS cur FROM te JOIN W USING (i) GROUP BY ALL), "
            f"th AS (SELECT {FRAC} * avg(m) AS thresh FROM (SELECT window_id, max(cur) AS m FROM fin GROUP BY ALL))")


@query("ttfs_threshold", f"WITH {NORM_SQL}, {TTFS_SQL} SELECT thresh FROM th")
def q_ttfs_threshold(spark, sf):
    ev = encode.ttfs_events(_norm(spark, sf))
    return readout.winning_current_threshold(ev, readout.weight_table(spark, C, N), FRAC)


@query("ttfs_decide",
       f"WITH {NORM_SQL}, {TTFS_SQL}, ps AS (SELECT window_id, t, class, sum(w) AS dw FROM te JOIN W USING (i) GROUP BY ALL), "
       "st AS (SELECT DISTINCT window_id, t FROM ps), "
       "grid AS (SELECT st.window_id, st.t, c.class FROM st, (SELECT DISTINCT class FROM W) c), "
       "full_ AS (SELECT g.window_id, g.t, g.class, sum(coalesce(ps.dw, 0.0)) OVER (PARTITION BY g.window_id, g.class "
       "ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM grid g LEFT JOIN ps USING (window_id, t, class)), "
       "lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, t ORDER BY cur DESC, class) AS rk "
       "FROM full_) WHERE rk = 1), "
       "dec AS (SELECT window_id, min(t) FILTER (WHERE cur >= (SELECT thresh FROM th)) AS td, max(t) AS tlast FROM lead GROUP BY ALL) "
       f"SELECT d.window_id, l.class AS pred, CAST(coalesce(d.td, {T - 1}) AS INTEGER) AS t_decide, d.td IS NOT NULL AS early "
       "FROM dec d JOIN lead l ON l.window_id = d.window_id AND l.t = coalesce(d.td, d.tlast)")
def q_ttfs_decide(spark, sf):
    ev = encode.ttfs_events(_norm(spark, sf))
    w = readout.weight_table(spark, C, N)
    th = readout.winning_current_threshold(ev, w, FRAC)
    return readout.ttfs_decide(ev, w, th, T).withColumn("t_decide", F.col("t_decide").cast("int"))


@query("synops",
       f"WITH {NORM_SQL}, {POIS_SQL} SELECT window_id, count(*) * {C} AS synops, CAST({T * N * C} AS BIGINT) AS dense_ops "
       "FROM pe GROUP BY ALL")
def q_synops(spark, sf):
    return readout.synops(encode.poisson_events(_norm(spark, sf), POISSON_SEED, POISSON_RATE), C, N, T)


N_EXPERTS, N_CLUSTERS, TOP_K, TEMP = 8, 16, 2, 0.5
ROUTE_SQL = ("cl AS (SELECT window_id, i % 16 AS cluster, sum(n) AS cn FROM cnt GROUP BY ALL), "
             "ex AS (SELECT window_id, CAST(cluster // 2 AS INTEGER) AS expert, sum(cn) AS en FROM cl GROUP BY ALL), "
             "ids AS (SELECT DISTINCT window_id FROM cnt), "
             "sp8 AS (SELECT window_id, CAST(unnest(range(0, 8)) AS INTEGER) AS expert FROM ids), "
             f"sc AS (SELECT s.window_id, s.expert, coalesce(ex.en / {float(T * 4 * 2)} / {TEMP}, 0.0) AS score FROM sp8 s "
             "LEFT JOIN ex USING (window_id, expert)), "
             "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, expert) AS rk "
             f"FROM sc) WHERE rk <= {TOP_K}), "
             "gt AS (SELECT window_id, expert, score, exp(score - max(score) OVER (PARTITION BY window_id)) AS ex FROM top), "
             "routes AS (SELECT window_id, expert, score, ex / sum(ex) OVER (PARTITION BY window_id) AS gate FROM gt)")


def _routes(spark, sf):
    return readout.expert_route(_counts(spark, sf), N, T, N_CLUSTERS, N_EXPERTS, TOP_K, TEMP)


@query("expert_route", f"WITH {NORM_SQL}, {POIS_SQL}, {ROUTE_SQL} SELECT window_id, expert, round(score, 9) AS score, "
       "round(gate, 6) AS gate FROM routes")
def q_route(spark, sf):
    r = _routes(spark, sf)
    return r.select("window_id", "expert", F.round("score", 9).alias("score"), F.round("gate", 6).alias("gate"))


@query("mixture_infer",
       f"WITH {NORM_SQL}, {POIS_SQL}, {ROUTE_SQL}, EW AS ({_w_sql(C, N_EXPERTS, 1)}), "
       "cur AS (SELECT c.window_id, r.expert, EW.class, sum(c.n * EW.w) AS cur FROM cnt c JOIN routes r USING (window_id) "
       "JOIN EW ON EW.expert = r.expert AND EW.i = c.i GROUP BY ALL), "
       "comb AS (SELECT cur.window_id, cur.class, sum(r.gate * cur.cur) AS combined FROM cur JOIN routes r "
       "USING (window_id, expert) GROUP BY ALL) "
       "SELECT window_id, pred, round(combined, 6) AS combined FROM (SELECT window_id, class AS pred, combined, "
       "row_number() OVER (PARTITION BY window_id ORDER BY combined DESC, class) AS rk FROM comb) WHERE rk = 1")
def q_mixture(spark, sf):
    ew = readout.weight_table(spark, C, N, N_EXPERTS, salt=1)
    m = readout.mixture_infer(_counts(spark, sf), _routes(spark, sf), ew)
    return m.select("window_id", "pred", F.round("combined", 6).alias("combined"))


@query("expert_usage",
       f"WITH {NORM_SQL}, {POIS_SQL}, {ROUTE_SQL} SELECT expert, count(*) AS used, count(*) / "
       "(SELECT count(*) FROM routes) AS share FROM routes GROUP BY ALL")
def q_usage(spark, sf):
    return readout.expert_usage(_routes(spark, sf))


RESP_SQL = ("resp AS (SELECT sample_id, CAST(idx % 64 AS INTEGER) AS unit, sum(cnt) AS response FROM fr GROUP BY ALL), "
            "labs AS (SELECT DISTINCT sample_id, label FROM fr), "
            "pc AS (SELECT label, count(*) AS n_c FROM labs GROUP BY ALL), "
            "s AS (SELECT r.unit, l.label, sum(r.response) AS r FROM resp r JOIN labs l USING (sample_id) GROUP BY ALL), "
            "us AS (SELECT u.unit, CAST(c.c AS INTEGER) AS label FROM (SELECT DISTINCT unit FROM resp) u, range(0, 3) c(c)), "
            "mr AS (SELECT us.unit, us.label, CAST(coalesce(s.r, 0) AS DOUBLE) / greatest(coalesce(pc.n_c, 0), 1) AS mean_response "
            "FROM us LEFT JOIN s USING (unit, label) LEFT JOIN pc USING (label)), "
            "asg AS (SELECT unit, label AS assigned, mean_response FROM (SELECT *, row_number() OVER (PARTITION BY unit "
            "ORDER BY mean_response DESC, label) AS rk FROM mr) WHERE rk = 1)")


def _responses(spark, sf):
    fr = frames.frames(_camera(spark, sf))
    resp = fr.groupBy("sample_id", (F.col("idx") % 64).cast("int").alias("unit")).agg(F.sum("cnt").alias("response"))
    labs = fr.select("sample_id", "label").distinct()
    return resp, labs


@query("unit_labels", f"WITH {CAM_SQL}, {FR_SQL}, {RESP_SQL} SELECT unit, assigned, round(mean_response, 6) AS mean_response "
       "FROM asg")
def q_unit_labels(spark, sf):
    resp, labs = _responses(spark, sf)
    a = readout.unit_labels(resp, labs, 3)
    return a.select("unit", "assigned", F.round("mean_response", 6).alias("mean_response"))


@query("population_vote",
       f"WITH {CAM_SQL}, {FR_SQL}, {RESP_SQL}, sc AS (SELECT r.sample_id, a.assigned AS label, sum(r.response) AS score "
       "FROM resp r JOIN asg a USING (unit) GROUP BY ALL), "
       "grid AS (SELECT i.sample_id, CAST(c.c AS INTEGER) AS label FROM (SELECT DISTINCT sample_id FROM resp) i, range(0, 3) c(c)), "
       "f AS (SELECT g.sample_id, g.label, CAST(coalesce(sc.score, 0) AS DOUBLE) AS score FROM grid g LEFT JOIN sc "
       "USING (sample_id, label)) SELECT sample_id, pred, score FROM (SELECT sample_id, label AS pred, score, "
       "row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, label) AS rk FROM f) WHERE rk = 1")
def q_vote(spark, sf):
    resp, labs = _responses(spark, sf)
    a = readout.unit_labels(resp, labs, 3)
    return readout.population_vote(resp, a, 3)


# ------------------------------------------------------------ associative recall
MEM_N, MEM_K, CUE_SEED = 256, 4, 11
MEM_SQL = ("mem AS (SELECT DISTINCT o.o_custkey AS bank, l.l_orderkey AS pattern_id, CAST(l.l_partkey % 256 AS INTEGER) AS neuron "
           "FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey), "
           f"cue AS (SELECT bank, pattern_id AS cue_id, neuron FROM mem WHERE {sql_hash_uniform(CUE_SEED, 'pattern_id', 'neuron')} >= 0.25 "
           "UNION SELECT DISTINCT bank, pattern_id AS cue_id, CAST((pattern_id * 7 + 3) % 256 AS INTEGER) AS neuron FROM mem)")
A = MEM_K / MEM_N
STEP_SQL = ("pc AS (SELECT bank, count(DISTINCT pattern_id) AS P FROM mem GROUP BY ALL), "
            "cn AS (SELECT bank, neuron, count(*) AS cnt FROM mem GROUP BY ALL), "
            "m AS (SELECT bank, cue_id, count(*) AS m FROM cue GROUP BY ALL), "
            "ov AS (SELECT c.bank, c.cue_id, mm.pattern_id, count(*) AS ov FROM cue c JOIN mem mm ON mm.bank = c.bank "
            "AND mm.neuron = c.neuron GROUP BY ALL), "
            "o AS (SELECT ov.bank, ov.cue_id, mm.neuron, sum(ov.ov) AS O FROM ov JOIN mem mm ON mm.bank = ov.bank "
            "AND mm.pattern_id = ov.pattern_id GROUP BY ALL), "
            f"spine AS (SELECT bank, cue_id, m, CAST(unnest(range(0, {MEM_N})) AS INTEGER) AS neuron FROM m), "
            f"s AS (SELECT sp.bank, sp.cue_id, sp.neuron, CAST(coalesce(o.O, 0) AS DOUBLE) - {A!r} * sp.m * coalesce(cn.cnt, 0) "
            f"- CASE WHEN c.neuron IS NOT NULL THEN coalesce(cn.cnt, 0) * {(1 - A) ** 2!r} + (pc.P - coalesce(cn.cnt, 0)) * {A * A!r} "
            "ELSE 0.0 END AS S FROM spine sp LEFT JOIN o USING (bank, cue_id, neuron) LEFT JOIN cn USING (bank, neuron) "
            "LEFT JOIN cue c ON c.bank = sp.bank AND c.cue_id = sp.cue_id AND c.neuron = sp.neuron JOIN pc USING (bank)), "
            "step AS (SELECT bank, cue_id, neuron FROM (SELECT *, row_number() OVER (PARTITION BY bank, cue_id ORDER BY S DESC, "
            f"neuron) AS rk FROM s) WHERE rk <= {MEM_K})")
_COUNTS, _ONE_STEP = STEP_SQL[:STEP_SQL.index("m AS (")], STEP_SQL[STEP_SQL.index("m AS ("):]


def _step_sql(j: int) -> str:
    """Step j of a recall, from the sets of the step before."""
    named = re.sub(r"\b(m|ov|o|spine|s|step)\b", rf"\g<1>{j}", _ONE_STEP)
    return re.sub(r"\bcue\b", "cue" if j == 1 else f"step{j - 1}", named).replace(f"step{j} AS (", f"step{j} AS MATERIALIZED (")


def _steps_sql(steps: int) -> str:
    return _COUNTS + ", ".join(_step_sql(j) for j in range(1, steps + 1))


def _patterns(spark, sf):
    """(bank, pattern_id, neuron), joined once."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    return memory.kept(li.join(o, o.o_orderkey == li.l_orderkey)
                       .select(F.col("o_custkey").alias("bank"), F.col("l_orderkey").alias("pattern_id"),
                               F.pmod(F.col("l_partkey"), F.lit(MEM_N)).cast("int").alias("neuron")).distinct(), "memory")


def _alien():
    return F.pmod(F.col("pattern_id") * 7 + 3, F.lit(MEM_N)).cast("int")


def _memory(spark, sf):
    mem = _patterns(spark, sf)
    keep = mem.filter(hash_uniform(CUE_SEED, F.col("pattern_id"), F.col("neuron")) >= 0.25).select(
        "bank", F.col("pattern_id").alias("cue_id"), "neuron")
    add = mem.select("bank", F.col("pattern_id").alias("cue_id"), _alien().alias("neuron"))
    return mem, keep.unionByName(add).distinct()


@query("recall_step", f"WITH {MEM_SQL}, {STEP_SQL} SELECT bank, cue_id, neuron FROM step")
def q_recall_step(spark, sf):
    mem, cues = _memory(spark, sf)
    return memory.recall_step(memory.MemoryIndex(mem, MEM_N), cues, MEM_N, MEM_K)


@query("pattern_overlap",
       f"WITH {MEM_SQL}, {STEP_SQL}, hit AS (SELECT s.bank, s.cue_id, count(*) AS hit FROM step s JOIN mem mm "
       "ON mm.bank = s.bank AND mm.pattern_id = s.cue_id AND mm.neuron = s.neuron GROUP BY ALL) "
       "SELECT i.bank, i.cue_id, coalesce(hit.hit, 0) / i.size AS overlap FROM (SELECT bank, "
       "pattern_id AS cue_id, count(*)::DOUBLE AS size FROM mem GROUP BY ALL) i LEFT JOIN hit USING (bank, cue_id)")
def q_overlap(spark, sf):
    mem, cues = _memory(spark, sf)
    idx = memory.MemoryIndex(mem, MEM_N)
    step = memory.recall_step(idx, cues, MEM_N, MEM_K)
    mem = idx.memory
    orig = mem.select("bank", F.col("pattern_id").alias("cue_id"), "neuron")
    return memory.overlap(step, orig)


RECALL_STEPS = 8
RECALL_SQL = (
    f"WITH {MEM_SQL}, {_steps_sql(RECALL_STEPS)}, sets AS ("
    + " UNION ALL ".join(f"SELECT {j} AS j, bank, cue_id, list(neuron ORDER BY neuron) AS x FROM {f'step{j}' if j else 'cue'} GROUP BY bank, cue_id"
                         for j in range(RECALL_STEPS + 1))
    + "), settled AS (SELECT a.bank, a.cue_id, min(a.j) AS j FROM sets a JOIN sets b ON b.bank = a.bank AND b.cue_id = a.cue_id "
    "AND b.j = a.j - 1 AND b.x = a.x GROUP BY ALL) "
    f"SELECT s.bank, s.cue_id, s.neuron, CAST(coalesce(t.j, {RECALL_STEPS}) AS INTEGER) AS steps_used FROM step{RECALL_STEPS} s "
    "LEFT JOIN settled t ON t.bank = s.bank AND t.cue_id = s.cue_id")


@query("recall", RECALL_SQL, note="iterative fixed point with checkpointed rounds")
def q_recall(spark, sf):
    idx = memory.MemoryIndex(_patterns(spark, sf), MEM_N, checkpoint=True)
    stored = idx.patterns.select("*", memory.luck(CUE_SEED).alias("luck"))
    cues = stored.select("bank", F.col("pattern_id").alias("cue_id"), memory.damaged(F.lit(0.25), _alien()).alias("s"))
    return memory.recall(idx, cues, MEM_N, MEM_K, steps=RECALL_STEPS)


# ------------------------------------------------------------ graph
DIM = 8
TRIPLES_SQL = ("tr AS (SELECT c_custkey + 1000 AS head, 0 AS rel, CAST(c_nationkey AS BIGINT) AS tail FROM customer "
               "UNION ALL SELECT s_suppkey + 100000000, 1, CAST(s_nationkey AS BIGINT) FROM supplier "
               "UNION ALL SELECT CAST(n_nationkey AS BIGINT), 2, CAST(n_regionkey + 100 AS BIGINT) FROM nation)")
ENT_SQL = ("ents AS (SELECT DISTINCT head AS id FROM tr UNION SELECT DISTINCT tail FROM tr UNION "
           "SELECT CAST(n_nationkey AS BIGINT) FROM nation UNION SELECT CAST(r_regionkey + 100 AS BIGINT) FROM region), "
           f"ev AS (SELECT id, d, ((id * (d + 3) + d * d) % 17 - 8) / 8.0 AS v FROM ents, range(0, {DIM}) x(d)), "
           f"rv AS (SELECT r AS rel, d, ((r * 5 + d * 3) % 9 - 4) / 8.0 AS v FROM range(0, 3) a(r), range(0, {DIM}) x(d)), "
           f"ep AS (SELECT id, d, ((id * (d + 5)) % 16) * {math.pi / 8!r} AS v FROM ents, range(0, {DIM}) x(d)), "
           f"rp AS (SELECT r AS rel, d, ((r * 3 + d) % 16) * {math.pi / 8!r} AS v FROM range(0, 3) a(r), range(0, {DIM}) x(d))")
KG_SEED = 5


def _kg_score_sql(src, e="ev", r="rv", kind="translational"):
    term = ("pow(h.v + r.v - t.v, 2)" if kind == "translational"
            else f"2.0 * abs(sin({graph.sql_wrap('h.v + r.v - t.v')} / 2.0))")
    agg = f"sqrt(sum({term}))" if kind == "translational" else f"sum({term})"
    return (f"SELECT q.head, q.rel, q.tail, {agg} AS score FROM {src} q JOIN {e} h ON h.id = q.head "
            f"JOIN {r} r ON r.rel = q.rel AND r.d = h.d JOIN {e} t ON t.id = q.tail AND t.d = h.d GROUP BY ALL")


def _kg(spark, sf):
    tr = adapters.triples(table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer"),
                          table(spark, sf, "supplier"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    regions = table(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("id"))
    ents = (tr.select(F.col("head").alias("id")).unionByName(tr.select(F.col("tail").alias("id")))
            .unionByName(nations).unionByName(regions).distinct())
    rels = spark.range(3).select(F.col("id").cast("int").alias("rel"))
    cands = (nations.select(F.lit(0).alias("rel"), F.col("id").alias("tail"))
             .unionByName(nations.select(F.lit(1).alias("rel"), F.col("id").alias("tail")))
             .unionByName(regions.select(F.lit(2).alias("rel"), F.col("id").alias("tail"))))
    return tr, ents, rels, cands


@query("triple_score", f"WITH {TRIPLES_SQL}, {ENT_SQL} {_kg_score_sql('tr')}")
def q_triple_score(spark, sf):
    tr, ents, rels, _ = _kg(spark, sf)
    return graph.translational_score(tr, graph.entity_vectors(ents, DIM), graph.relation_vectors(rels, DIM))


@query("rotation_score", f"WITH {TRIPLES_SQL}, {ENT_SQL} SELECT head, rel, tail, round(score, 9) AS score FROM "
       f"({_kg_score_sql('tr', 'ep', 'rp', 'rotational')})")
def q_rotation_score(spark, sf):
    tr, ents, rels, _ = _kg(spark, sf)
    s = graph.rotational_score(tr, graph.entity_phases(ents, DIM), graph.relation_phases(rels, DIM))
    return s.withColumn("score", F.round("score", 9))


TEST_SQL = f"test AS (SELECT * FROM tr WHERE {sql_hash_uniform(KG_SEED, 'head', 'rel', 'tail')} < 0.15)"
CAND_SQL = ("cand AS (SELECT 0 AS rel, CAST(n_nationkey AS BIGINT) AS tail FROM nation UNION ALL "
            "SELECT 1, CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 2, CAST(r_regionkey + 100 AS BIGINT) FROM region)")
RANK_SQL = (f"{TEST_SQL}, {CAND_SQL}, "
            "cor AS (SELECT t.head, t.rel, t.tail AS true_tail, c.tail FROM test t JOIN cand c USING (rel)), "
            f"sc AS (SELECT head, rel, tail, round(score, 9) AS score FROM ({_kg_score_sql('(SELECT DISTINCT head, rel, tail FROM cor)')})), "
            "j AS (SELECT cor.*, sc.score FROM cor JOIN sc USING (head, rel, tail)), "
            "tru AS (SELECT head, rel, true_tail, score AS ts FROM j WHERE tail = true_tail), "
            "ranks AS (SELECT j.head, j.rel, j.true_tail AS tail, 1 + count(*) FILTER (WHERE j.score < tru.ts OR "
            "(j.score = tru.ts AND j.tail < tru.true_tail)) AS rank FROM j JOIN tru USING (head, rel, true_tail) GROUP BY ALL)")


def _ranks(spark, sf):
    tr, ents, rels, cands = _kg(spark, sf)
    test = tr.filter(hash_uniform(KG_SEED, F.col("head"), F.col("rel"), F.col("tail")) < 0.15)
    return graph.link_ranks(test, cands, graph.entity_vectors(ents, DIM), graph.relation_vectors(rels, DIM))


@query("link_rank", f"WITH {TRIPLES_SQL}, {ENT_SQL}, {RANK_SQL} SELECT head, rel, tail, rank FROM ranks")
def q_link_rank(spark, sf):
    return _ranks(spark, sf)


@query("link_metrics", f"WITH {TRIPLES_SQL}, {ENT_SQL}, {RANK_SQL} SELECT count(*) AS n, "
       "round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hits1, "
       "round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits3, round(avg(1.0 / rank), 6) AS mrr FROM ranks")
def q_link_metrics(spark, sf):
    m = graph.link_metrics(_ranks(spark, sf))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("hits1", "hits3", "mrr")])


@query("relation_hits1", f"WITH {TRIPLES_SQL}, {ENT_SQL}, {RANK_SQL} SELECT rel, count(*) AS n, "
       "round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hits1 FROM ranks GROUP BY rel")
def q_rel_hits(spark, sf):
    h = graph.per_relation_hits1(_ranks(spark, sf))
    return h.select("rel", "n", F.round("hits1", 6).alias("hits1"))


ANOM_SQL = (f"{TEST_SQL}, bad AS (SELECT head, rel, CASE WHEN rel = 2 THEN 100 + (tail - 100 + 1 + head % 4) % 5 "
            "ELSE (tail + 1 + head % 24) % 25 END AS tail FROM test)")


@query("anomaly_gap",
       f"WITH {TRIPLES_SQL}, {ENT_SQL}, {ANOM_SQL}, a AS ({_kg_score_sql('test')}), b AS ({_kg_score_sql('bad')}) "
       "SELECT round((SELECT avg(score) FROM a), 6) AS mean_true, round((SELECT avg(score) FROM b), 6) AS mean_random, "
       "round((SELECT avg(score) FROM b) / (SELECT avg(score) FROM a), 6) AS gap_ratio")
def q_anomaly(spark, sf):
    tr, ents, rels, _ = _kg(spark, sf)
    test = tr.filter(hash_uniform(KG_SEED, F.col("head"), F.col("rel"), F.col("tail")) < 0.15)
    bad = test.select("head", "rel", F.when(F.col("rel") == 2, F.lit(100) + F.pmod(F.col("tail") - 100 + 1 + F.pmod("head", F.lit(4)), F.lit(5)))
                      .otherwise(F.pmod(F.col("tail") + 1 + F.pmod("head", F.lit(24)), F.lit(25))).cast("bigint").alias("tail"))
    ev, rv = graph.entity_vectors(ents, DIM), graph.relation_vectors(rels, DIM)
    a = graph.translational_score(test, ev, rv).agg(F.avg("score").alias("mt"))
    b = graph.translational_score(bad, ev, rv).agg(F.avg("score").alias("mr"))
    return a.join(b, how="cross").select(F.round("mt", 6).alias("mean_true"), F.round("mr", 6).alias("mean_random"),
                                         F.round(F.col("mr") / F.col("mt"), 6).alias("gap_ratio"))


# relations with a known algebra over the given tables: 3 = inverse of 0 (nation->customer),
# 4 = 0 then 2 (customer->region), 5 = suppliers of one nation, both ways (its own inverse)
ALGEBRA = [("inverse", 0, 3, None), ("self_inverse", 5, 5, None), ("composition", 0, 2, 4)]
_ALG_VALUES = ", ".join(f"('{n}', {a}, {b}, {'NULL' if c is None else c})" for n, a, b, c in ALGEBRA)
ALG_SQL = ("alg AS (SELECT * FROM tr UNION ALL SELECT tail, 3, head FROM tr WHERE rel = 0 "
           "UNION ALL SELECT a.head, 4, b.tail FROM tr a JOIN tr b ON a.rel = 0 AND b.rel = 2 AND b.head = a.tail "
           "UNION ALL SELECT x, 5, y FROM (SELECT head AS x, lead(head) OVER (PARTITION BY tail ORDER BY head) AS y FROM tr WHERE rel = 1) WHERE y IS NOT NULL "
           "UNION ALL SELECT y, 5, x FROM (SELECT head AS x, lead(head) OVER (PARTITION BY tail ORDER BY head) AS y FROM tr WHERE rel = 1) WHERE y IS NOT NULL), "
           "fit AS (SELECT q.rel, h.d, atan2(round(sum(sin(t.v - h.v)), 9), round(sum(cos(t.v - h.v)), 9)) AS v FROM alg q "
           "JOIN ep h ON h.id = q.head JOIN ep t ON t.id = q.tail AND t.d = h.d GROUP BY q.rel, h.d), "
           f"ident AS (SELECT * FROM (VALUES {_ALG_VALUES}) v(name, a, b, c))")


@query("relation_algebra",
       f"WITH {TRIPLES_SQL}, {ENT_SQL}, {ALG_SQL} SELECT name, "
       f"round(avg(abs({graph.sql_wrap('x.v + y.v - coalesce(z.v, 0.0)')})), 6) AS err FROM ident JOIN fit x ON x.rel = a "
       "JOIN fit y ON y.rel = b AND y.d = x.d LEFT JOIN fit z ON z.rel = c AND z.d = x.d GROUP BY name")
def q_rel_algebra(spark, sf):
    tr, ents, _, _ = _kg(spark, sf)
    inverse = tr.where("rel = 0").select(F.col("tail").alias("head"), F.lit(3).alias("rel"), F.col("head").alias("tail"))
    through = tr.where("rel = 2").select(F.col("head").alias("mid"), F.col("tail").alias("end"))
    composed = tr.where("rel = 0").join(through, F.col("tail") == F.col("mid")).select("head", F.lit(4).alias("rel"), F.col("end").alias("tail"))
    follow = Window.partitionBy("tail").orderBy("head")
    pairs = (tr.where("rel = 1").select(F.col("head").alias("x"), F.lead("head").over(follow).alias("y")).where("y IS NOT NULL"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("head"), F.col("y").alias("tail")),
                                          F.struct(F.col("y").alias("head"), F.col("x").alias("tail")))).alias("p"))
    every = (tr.unionByName(inverse).unionByName(composed)
             .unionByName(both.select("p.head", F.lit(5).alias("rel"), "p.tail")))
    identities = spark.createDataFrame(ALGEBRA, "name string, a int, b int, c int")
    fitted = graph.fit_relation_phases(every, graph.entity_phases(ents, DIM))
    return graph.algebra_errors(fitted, identities).select("name", F.round("err", 6).alias("err"))


# noise sweep (F15): several corruption levels in one recall job
SWEEP_DROPS = [0.1, 0.25, 0.5]


_GRID_VALUES = ", ".join(f"({g}, CAST({f!r} AS DOUBLE))" for g, f in enumerate(SWEEP_DROPS))
SWEEP_SQL = ("WITH mem AS (SELECT DISTINCT o.o_custkey AS bank, l.l_orderkey AS pattern_id, "
             "CAST(l.l_partkey % 256 AS INTEGER) AS neuron FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey), "
             f"grids AS (SELECT * FROM (VALUES {_GRID_VALUES}) v(g, frac)), "
             f"cue AS (SELECT bank, pattern_id * 8 + g AS cue_id, neuron FROM mem, grids "
             f"WHERE {sql_hash_uniform(CUE_SEED, 'pattern_id', 'neuron')} >= frac "
             "UNION SELECT DISTINCT bank, pattern_id * 8 + g AS cue_id, CAST((pattern_id * 7 + 3) % 256 AS INTEGER) AS neuron "
             f"FROM mem, grids), {STEP_SQL}, "
             "hit AS (SELECT s.bank, s.cue_id, count(*) AS hit FROM step s JOIN mem mm ON mm.bank = s.bank "
             "AND mm.pattern_id = s.cue_id // 8 AND mm.neuron = s.neuron GROUP BY ALL), "
             "size AS (SELECT bank, pattern_id, count(*)::DOUBLE AS size FROM mem GROUP BY ALL), "
             "per AS (SELECT CAST(c.cue_id % 8 AS INTEGER) AS grid, coalesce(hit.hit, 0) / z.size AS overlap "
             "FROM (SELECT DISTINCT bank, cue_id FROM cue) c JOIN size z ON z.bank = c.bank AND z.pattern_id = c.cue_id // 8 "
             "LEFT JOIN hit ON hit.bank = c.bank AND hit.cue_id = c.cue_id) "
             "SELECT p.grid, round(avg(p.overlap), 9) AS mean_overlap, count(*) AS n_cues, g.frac AS drop_fraction FROM per p "
             "JOIN grids g ON g.g = p.grid GROUP BY p.grid, g.frac")


@query("recall_sweep", SWEEP_SQL, note="parameter grid x recall step in one job")
def q_recall_sweep(spark, sf):
    idx = memory.MemoryIndex(_patterns(spark, sf), MEM_N)
    stored = idx.patterns.select("*", memory.luck(CUE_SEED).alias("luck"), F.posexplode(F.array(*[F.lit(x) for x in SWEEP_DROPS])).alias("grid", "drop"))
    cues = stored.select("bank", F.struct("grid", "pattern_id", "members", "size").alias("cue_id"), memory.damaged(F.col("drop"), _alien()).alias("s"))
    step = memory.recall_step(idx, cues, MEM_N, MEM_K, as_sets=True)
    per = step.select("cue_id.grid", (F.size(F.array_intersect("new", "cue_id.members")) / F.col("cue_id.size")).alias("overlap"))
    drops = spark.createDataFrame([(g, f) for g, f in enumerate(SWEEP_DROPS)], "grid int, drop_fraction double")
    return per.groupBy("grid").agg(F.round(F.avg("overlap"), 9).alias("mean_overlap"), F.count(F.lit(1)).alias("n_cues")).join(
        F.broadcast(drops), "grid")


# capacity sweep (F15): noise and nested loads, to the fixed point
CAP_NOISES, CAP_LOADS, CAP_STEPS, CAP_FLOOR = [0.1, 0.5], [0.25, 0.5, 1.0], 6, 0.9
_CAP_U = sql_hash_uniform(CUE_SEED, "pattern_id")
_CAP_GRID = (f"loads AS (SELECT * FROM (VALUES {', '.join(f'({j}, CAST({x!r} AS DOUBLE))' for j, x in enumerate(CAP_LOADS))}) v(j, load)), "
             f"noise AS (SELECT * FROM (VALUES {', '.join(f'({j}, CAST({x!r} AS DOUBLE))' for j, x in enumerate(CAP_NOISES))}) v(g, frac))")
CAPACITY_SQL = (
    "WITH base AS (SELECT DISTINCT o.o_custkey AS bank, l.l_orderkey AS pattern_id, CAST(l.l_partkey % 256 AS INTEGER) AS neuron "
    f"FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey), {_CAP_GRID}, "
    f"mem AS MATERIALIZED (SELECT bank * {len(CAP_LOADS)} + j AS bank, pattern_id, neuron FROM base JOIN loads ON {_CAP_U} < load OR load = 1.0), "
    "cue AS MATERIALIZED (SELECT bank, pattern_id * 8 + g AS cue_id, neuron FROM mem, noise "
    f"WHERE {sql_hash_uniform(CUE_SEED, 'pattern_id', 'neuron')} >= frac "
    "UNION SELECT DISTINCT bank, pattern_id * 8 + g AS cue_id, CAST((pattern_id * 7 + 3) % 256 AS INTEGER) AS neuron FROM mem, noise), "
    + _steps_sql(CAP_STEPS) +
    f", hit AS (SELECT s.bank, s.cue_id, count(*) AS hit FROM step{CAP_STEPS} s JOIN mem mm ON mm.bank = s.bank AND mm.pattern_id = s.cue_id // 8 "
    "AND mm.neuron = s.neuron GROUP BY ALL), "
    "size AS (SELECT bank, pattern_id, count(*)::DOUBLE AS size FROM mem GROUP BY ALL), "
    f"per AS (SELECT z.bank // {len(CAP_LOADS)} AS bank, frac AS drop_fraction, load, count(*) AS stored, avg(coalesce(hit.hit, 0) / z.size) AS r "
    f"FROM size z CROSS JOIN noise JOIN loads ON j = z.bank % {len(CAP_LOADS)} LEFT JOIN hit ON hit.bank = z.bank AND hit.cue_id = z.pattern_id * 8 + g GROUP BY ALL) "
    "SELECT bank, drop_fraction, load, stored, round(r, 9) AS mean_recall, "
    f"min(CASE WHEN r < {CAP_FLOOR} - 1e-12 THEN stored END) OVER (PARTITION BY bank, drop_fraction) AS knee FROM per")


@query("recall_capacity", CAPACITY_SQL, note="noise x nested loads, recall to the fixed point, the first load under 90 % of each bank")
def q_recall_capacity(spark, sf):
    out = memory.capacity_sweep(_patterns(spark, sf), CAP_NOISES, CAP_LOADS, MEM_N, MEM_K, _alien(),
                                steps=CAP_STEPS, floor=CAP_FLOOR - 1e-12, seed=CUE_SEED)
    return out.withColumn("mean_recall", F.round("mean_recall", 9))


@query("affinity_route",
       f"WITH {NORM_SQL}, {POIS_SQL}, {ROUTE_SQL}, EW AS ({_w_sql(C, N_EXPERTS, 1)}), "
       "use_ AS (SELECT expert, count(*) / (SELECT count(*) FROM routes) AS share FROM routes GROUP BY ALL), "
       "cs AS (SELECT expert, i, sum(w) AS cs FROM EW GROUP BY ALL), "
       f"aff AS (SELECT c.window_id, cs.expert, sum(c.n / {float(T)} * cs.cs) AS aff FROM cnt c JOIN cs USING (i) GROUP BY ALL), "
       f"asc_ AS (SELECT a.window_id, a.expert, a.aff - {readout.LOAD_BALANCE} * coalesce(u.share, 0.0) * a.aff AS score "
       "FROM aff a LEFT JOIN use_ u USING (expert)) "
       "SELECT window_id, expert, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY window_id "
       f"ORDER BY score DESC, expert) AS rk FROM asc_) WHERE rk <= {TOP_K}")
def q_affinity(spark, sf):
    ew = readout.weight_table(spark, C, N, N_EXPERTS, salt=1)
    usage = readout.expert_usage(_routes(spark, sf))
    r = readout.affinity_route(_counts(spark, sf), ew, usage, T, TOP_K)
    return r.select("window_id", "expert", "rk")


@query("link_fit_metrics", None, note="fit translational embeddings (synchronous rounds), then Hits@k / MRR on held-out triples")
def q_link_fit(spark, sf):
    tr, ents, rels, cands = _kg(spark, sf)
    u = hash_uniform(KG_SEED, F.col("head"), F.col("rel"), F.col("tail"))
    train, test = tr.filter(u >= 0.15), tr.filter(u < 0.15)
    ev, rv = graph.fit_translational(train, cands, ents, dim=DIM, rounds=5)
    ranks = graph.link_ranks(test, cands, ev, rv)
    return graph.link_metrics(ranks)


@query("link_fit_rotational", None, note="fit phase embeddings (synchronous rounds, K negatives), then Hits@k / MRR")
def q_link_fit_rot(spark, sf):
    tr, ents, rels, cands = _kg(spark, sf)
    u = hash_uniform(KG_SEED, F.col("head"), F.col("rel"), F.col("tail"))
    train, test = tr.filter(u >= 0.15), tr.filter(u < 0.15)
    ep, rp = graph.fit_rotational(train, cands, ents, dim=DIM, rounds=5)
    return graph.link_metrics(graph.link_ranks(test, cands, ep, rp, kind="rotational"))
