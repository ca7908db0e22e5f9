"""Knowledge-graph scoring and link-prediction metrics.

Embeddings are ``(id, d, v)`` rows; scores are joins on the dimension and
grouped sums.  Ranking compares each test triple only with the candidate
tails of its relation's target type (an equi-join on the relation), never
with all entities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_vectors(ids: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """Deterministic translational embedding in multiples of 1/8:
    ``v = ((id*(d+3) + d*d) % 17 - 8) / 8``."""
    return ids.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")).select(
        "id", "d", ((F.pmod(F.col("id") * (F.col("d") + 3) + F.col("d") * F.col("d"), F.lit(17)) - 8) / F.lit(8.0)).alias("v"))


def relation_vectors(rels: DataFrame, dim: int) -> DataFrame:
    """Relation offsets ``((r*5 + d*3) % 9 - 4) / 8``."""
    return rels.select("rel", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")).select(
        "rel", "d", ((F.pmod(F.col("rel") * 5 + F.col("d") * 3, F.lit(9)) - 4) / F.lit(8.0)).alias("v"))


def entity_phases(ids: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """Phases on a 16-step circle: ``((id*(d+5)) % 16) * pi / 8``."""
    return ids.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")).select(
        "id", "d", (F.pmod(F.col("id") * (F.col("d") + 5), F.lit(16)) * F.lit(math.pi / 8)).alias("v"))


def relation_phases(rels: DataFrame, dim: int) -> DataFrame:
    return rels.select("rel", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")).select(
        "rel", "d", (F.pmod(F.col("rel") * 3 + F.col("d"), F.lit(16)) * F.lit(math.pi / 8)).alias("v"))


def wrap(x: Column) -> Column:
    """Angle to (-pi, pi]."""
    two_pi = 2 * math.pi
    r = (x + F.lit(math.pi)) % F.lit(two_pi)
    r = F.when(r < 0, r + F.lit(two_pi)).otherwise(r)
    y = r - F.lit(math.pi)
    return F.when(y == F.lit(-math.pi), F.lit(math.pi)).otherwise(y)


def sql_wrap(x: str) -> str:
    """DuckDB twin of :func:`wrap`."""
    pi, tp = repr(math.pi), repr(2 * math.pi)
    r = f"fmod(({x}) + {pi}, {tp})"
    r = f"(CASE WHEN {r} < 0 THEN {r} + {tp} ELSE {r} END)"
    return f"(CASE WHEN {r} - {pi} = -{pi} THEN {pi} ELSE {r} - {pi} END)"


def as_arrays(vectors: DataFrame, key: str) -> DataFrame:
    """(key, vec): one array per id, dimensions in order (groups of one row per dimension)."""
    return vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("__dv")).select(
        key, F.transform("__dv", lambda x: x["v"]).alias("vec"))


def _score(triples: DataFrame, ent: DataFrame, rel: DataFrame, kind: str) -> DataFrame:
    """One score per row of ``triples``, repeated rows included: each id is
    joined once as an array and the score is a projection."""
    e = as_arrays(ent, "id")
    j = (triples.join(as_arrays(rel, "rel").withColumnRenamed("vec", "__r"), "rel")
         .join(e.select(F.col("id").alias("head"), F.col("vec").alias("__h")), "head")
         .join(e.select(F.col("id").alias("tail"), F.col("vec").alias("__t")), "tail"))
    gap = F.zip_with(F.zip_with("__h", "__r", lambda x, y: x + y), "__t", lambda x, y: x - y)
    if kind == "translational":
        score = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    else:
        score = F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.lit(2.0) * F.abs(F.sin(wrap(x) / F.lit(2.0))))
    return j.select(*triples.columns, score.alias("score"))


def translational_score(triples: DataFrame, ent: DataFrame, rel: DataFrame) -> DataFrame:
    """``||e_h + d_r - e_t||_2`` per triple (lower = more plausible)."""
    return _score(triples, ent, rel, "translational")


def rotational_score(triples: DataFrame, ent: DataFrame, rel: DataFrame) -> DataFrame:
    """``sum_d 2|sin(wrap(th_h + ph_r - th_t)/2)|`` per triple."""
    return _score(triples, ent, rel, "rotational")


def link_ranks(test: DataFrame, candidates: DataFrame, ent: DataFrame, rel: DataFrame, kind: str = "translational",
               digits: int = 9) -> DataFrame:
    """Rank of the true tail among the candidate tails of the relation:
    ``1 + #(score < true) + #(score == true and id < true)``.

    ``candidates`` = (rel, tail) rows; scores are rounded to ``digits``
    before comparison so equal scores tie deterministically.
    """
    asked = test.select("head", "rel", "tail")
    once = asked.distinct().withColumnRenamed("tail", "true_tail")
    c = _score(once.join(candidates.select("rel", "tail").distinct(), "rel"), ent, rel, kind).withColumn("score", F.round("score", digits))
    true = F.max(F.when(F.col("tail") == F.col("true_tail"), F.col("score")))
    per = c.groupBy("head", "rel", "true_tail").agg(true.alias("ts"))
    better = (F.col("score") < F.col("ts")) | ((F.col("score") == F.col("ts")) & (F.col("tail") < F.col("true_tail")))
    ranks = (c.join(per.where(F.col("ts").isNotNull()), ["head", "rel", "true_tail"])
             .groupBy("head", "rel", "true_tail").agg((F.lit(1) + F.count_if(better)).alias("rank")))
    return asked.join(ranks.withColumnRenamed("true_tail", "tail"), ["head", "rel", "tail"])


def link_metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") <= 1).cast("double")).alias("hits1"),
                     F.avg((F.col("rank") <= 3).cast("double")).alias("hits3"),
                     F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"))


def per_relation_hits1(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") <= 1).cast("double")).alias("hits1"))


def fit_relation_phases(triples: DataFrame, ent: DataFrame) -> DataFrame:
    """(rel, d, v): each relation's phases fitted to its triples, the circular
    mean of ``th_t - th_h``, the least-squares rotation on the unit circle."""
    e = as_arrays(ent, "id")
    j = (triples.select("head", "rel", "tail").join(e.select(F.col("id").alias("head"), F.col("vec").alias("h")), "head")
         .join(e.select(F.col("id").alias("tail"), F.col("vec").alias("t")), "tail"))
    turn = j.select("rel", F.posexplode(F.zip_with("t", "h", lambda x, y: x - y)).alias("d", "x"))
    return turn.groupBy("rel", "d").agg(F.sum(F.sin("x")).alias("s"), F.sum(F.cos("x")).alias("c")).select(
        "rel", "d", F.atan2(F.round("s", 9), F.round("c", 9)).alias("v"))


def algebra_errors(rel: DataFrame, identities: DataFrame) -> DataFrame:
    """(name, err): mean circular error of ``a + b = c`` on the fitted phases.

    ``identities`` = (name, a, b, c), c null for zero: an inverse pair is
    a + b = 0, a self-inverse relation a + a = 0, a composition a + b = c.
    """
    one = lambda n: rel.select(F.col("rel").alias(n), "d", F.col("v").alias(f"v{n}"))
    j = identities.join(one("a"), "a").join(one("b"), ["b", "d"]).join(one("c"), ["c", "d"], "left")
    err = F.abs(wrap(F.col("va") + F.col("vb") - F.coalesce("vc", F.lit(0.0))))
    return j.groupBy("name").agg(F.avg(err).alias("err"))


def indexed_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rel, pick, tail), (rel, n)): the candidate tails numbered 1..n per
    relation, in blocks of ids, so a draw is an equi-join and no relation's
    tails meet in one row."""
    from eventlake.operators.ordered import seq_number
    one = candidates.select("rel", "tail").distinct()
    numbered = seq_number(one, ["rel"], ["tail"], F.floor(F.col("tail") / F.lit(1 << 16)).cast("bigint"), "pick")
    return numbered.select("rel", "pick", F.col("tail").alias("tn")), one.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def _vadd(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _vsub(a, b):
    return F.zip_with(a, b, lambda x, y: x - y)


def _vnorm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def _vscale(a, s):
    return F.transform(a, lambda x: x * s)


def fit_translational(train: DataFrame, candidates: DataFrame, entities: DataFrame, dim: int = 8,
                      rounds: int = 20, lr: float = 0.1, margin: float = 1.0, seed: int = 0):
    """Fit translational embeddings with synchronous rounds.

    Each round scores every training triple against one corrupted tail drawn
    (keyed uniform) from the relation's candidate tails; triples violating
    the margin contribute ``unit(p) - unit(n)`` to head and relation,
    ``-unit(p)`` to the true tail and ``+unit(n)`` to the corrupted tail.
    Gradients are averaged per entity (partial aggregation absorbs hot
    entities; averaging keeps a hub's step size independent of its degree),
    applied, entities are projected into the unit ball, and the
    tables are checkpointed.  Returns (entity (id, d, v), relation (rel, d, v)).
    """
    from eventlake.functions.rng import hash_uniform
    from eventlake.session import cut_lineage

    def init(df, key, scale, salt):
        return df.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                          lambda d: (hash_uniform(seed + salt, F.col(key), d) * 2 - 1) * F.lit(scale)).alias("vec"))

    E = cut_lineage(init(entities.select(F.col("id")), "id", 0.5, 1))
    R = cut_lineage(init(train.select("rel").distinct(), "rel", 0.1, 2))
    numbered, sizes = (cut_lineage(x) for x in indexed_candidates(candidates))
    tr = cut_lineage(train.select("head", "rel", "tail").join(sizes, "rel"))
    for rnd in range(rounds):
        u = hash_uniform(seed, F.lit(rnd), F.col("head"), F.col("rel"), F.col("tail"))
        t = (tr.select("head", "rel", "tail", (F.floor(u * F.col("n")) + 1).cast("bigint").alias("pick"))
             .join(numbered, ["rel", "pick"]).drop("pick").filter(F.col("tn") != F.col("tail"))
             .join(E.select(F.col("id").alias("head"), F.col("vec").alias("eh")), "head")
             .join(R.select("rel", F.col("vec").alias("er")), "rel")
             .join(E.select(F.col("id").alias("tail"), F.col("vec").alias("et")), "tail")
             .join(E.select(F.col("id").alias("tn"), F.col("vec").alias("en")), "tn"))
        p = _vsub(_vadd("eh", "er"), F.col("et"))
        n = _vsub(_vadd("eh", "er"), F.col("en"))
        t = t.select("head", "rel", "tail", "tn", p.alias("p"), n.alias("n"))
        t = t.filter(F.lit(margin) + _vnorm(F.col("p")) - _vnorm(F.col("n")) > 0)
        dp = _vscale(F.col("p"), F.lit(1.0) / F.greatest(_vnorm(F.col("p")), F.lit(1e-12)))
        dn = _vscale(F.col("n"), F.lit(1.0) / F.greatest(_vnorm(F.col("n")), F.lit(1e-12)))
        g = cut_lineage(t.select("head", "rel", "tail", "tn", _vsub(dp, dn).alias("g"), dp.alias("dp"), dn.alias("dn")))
        ent_grads = (g.select(F.col("head").alias("id"), F.col("g").alias("gv"))
                     .unionByName(g.select(F.col("tail").alias("id"), _vscale(F.col("dp"), F.lit(-1.0)).alias("gv")))
                     .unionByName(g.select(F.col("tn").alias("id"), F.col("dn").alias("gv"))))
        eg = (ent_grads.select("id", F.posexplode("gv").alias("d", "x")).groupBy("id", "d").agg(F.avg("x").alias("x"))
              .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("gm")))
        rg = (g.select("rel", F.posexplode("g").alias("d", "x")).groupBy("rel", "d").agg(F.avg("x").alias("x"))
              .groupBy("rel").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("gm")))

        def apply(tab, grads, key):
            j = tab.join(grads, key, "left")
            step = F.transform("vec", lambda v, d: v - F.lit(lr) * F.coalesce(F.element_at(F.col("gm"), d), F.lit(0.0)))
            return j.select(key, step.alias("vec"))

        E2 = apply(E, eg, "id")
        nrm = _vnorm(F.col("vec"))
        E = cut_lineage(E2.select("id", F.when(nrm > 1.0, _vscale(F.col("vec"), F.lit(1.0) / nrm)).otherwise(F.col("vec"))
                                  .alias("vec")))
        R = cut_lineage(apply(R, rg, "rel"))
    ent = E.select("id", F.posexplode("vec").alias("d", "v"))
    rel = R.select("rel", F.posexplode("vec").alias("d", "v"))
    return ent, rel


def fit_rotational(train: DataFrame, candidates: DataFrame, entities: DataFrame, dim: int = 8, rounds: int = 20,
                   lr: float = 0.1, margin: float = 1.0, negatives: int = 5, seed: int = 0):
    """Fit phase embeddings (rotations) with synchronous rounds, K negative
    tails per triple, learning rate decayed linearly to 30%.  Per dimension
    ``dp = wrap(th_h + ph_r - th_t)``; a margin violation moves head and
    relation by ``-g(dp) + g(dn)``, the tail by ``g(dp)`` and the negative by
    ``-g(dn)`` with ``g(x) = sign(x) cos(x/2)``; updates are averaged per
    entity and phases kept in [0, 2pi).  Returns (entity, relation) phase rows."""
    from eventlake.functions.rng import hash_uniform
    from eventlake.session import cut_lineage
    two_pi = 2 * math.pi

    def init(df, key, lo, hi, salt):
        return df.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.lit(lo) + hash_uniform(
            seed + salt, F.col(key), d) * F.lit(hi - lo)).alias("vec"))

    def score(a, b, c):
        return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x + y), c, lambda x, y: x - y), F.lit(0.0),
                           lambda acc, x: acc + F.lit(2.0) * F.abs(F.sin(wrap(x) / F.lit(2.0))))

    def grad(a, b, c):
        return F.transform(F.zip_with(F.zip_with(a, b, lambda x, y: x + y), c, lambda x, y: x - y),
                           lambda x: F.signum(wrap(x)) * F.cos(wrap(x) / F.lit(2.0)))

    E = cut_lineage(init(entities.select("id"), "id", 0.0, two_pi, 3))
    R = cut_lineage(init(train.select("rel").distinct(), "rel", -0.3, 0.3, 4))
    numbered, sizes = (cut_lineage(x) for x in indexed_candidates(candidates))
    tr = cut_lineage(train.select("head", "rel", "tail").join(sizes, "rel"))
    for rnd in range(rounds):
        step_lr = lr * (1.0 - 0.7 * rnd / max(1, rounds))
        negs = tr.select("head", "rel", "tail", "n", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("j"))
        u = hash_uniform(seed, F.lit(rnd), F.col("j"), F.col("head"), F.col("rel"), F.col("tail"))
        t = (negs.select("head", "rel", "tail", (F.floor(u * F.col("n")) + 1).cast("bigint").alias("pick"))
             .join(numbered, ["rel", "pick"]).drop("pick").filter(F.col("tn") != F.col("tail"))
             .join(E.select(F.col("id").alias("head"), F.col("vec").alias("eh")), "head")
             .join(R.select("rel", F.col("vec").alias("er")), "rel")
             .join(E.select(F.col("id").alias("tail"), F.col("vec").alias("et")), "tail")
             .join(E.select(F.col("id").alias("tn"), F.col("vec").alias("en")), "tn"))
        t = t.filter(F.lit(margin) + score(F.col("eh"), F.col("er"), F.col("et"))
                     - score(F.col("eh"), F.col("er"), F.col("en")) > 0)
        g = cut_lineage(t.select("head", "rel", "tail", "tn", grad(F.col("eh"), F.col("er"), F.col("et")).alias("gp"),
                                 grad(F.col("eh"), F.col("er"), F.col("en")).alias("gn")))       # four updates read it
        hr = F.zip_with("gp", "gn", lambda p, n: -p + n)
        ent_up = (g.select(F.col("head").alias("id"), hr.alias("u"))
                  .unionByName(g.select(F.col("tail").alias("id"), F.col("gp").alias("u")))
                  .unionByName(g.select(F.col("tn").alias("id"), _vscale(F.col("gn"), F.lit(-1.0)).alias("u"))))

        def avg_by(df, key):
            return (df.select(key, F.posexplode("u").alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
                    .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("gm")))

        def apply(tab, ups, key):
            j = tab.join(ups, key, "left")
            nv = F.transform("vec", lambda v, d: F.pmod(v + F.lit(step_lr) * F.coalesce(F.element_at(F.col("gm"), d),
                                                                                        F.lit(0.0)), F.lit(two_pi)))
            return j.select(key, nv.alias("vec"))

        E = cut_lineage(apply(E, avg_by(ent_up, "id"), "id"))
        R = cut_lineage(apply(R, avg_by(g.select("rel", hr.alias("u")), "rel"), "rel"))
    return (E.select("id", F.posexplode("vec").alias("d", "v")), R.select("rel", F.posexplode("vec").alias("d", "v")))
