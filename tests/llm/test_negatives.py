"""Hard negatives against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import negatives as N
from eventlake.llm.negatives import Anchors, encode, hard_negatives, rotated, scores

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, few=5):
    ok = []
    for i, e, lab in rows:
        if i is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        ok.append((i, [math.floor(256 * float(np.float32(x))) for x in e], lab))
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    out = []
    for k, (i, v, lab) in enumerate(ok):
        if i % 100:
            continue
        others = sorted(((-dot(v, w), j, m) for n, (j, w, m) in enumerate(ok) if n != k), key=lambda x: x[:2])
        for p, j, m in [o for o in others if o[2] == lab][:few]:
            fit = [o for o in others if o[2] != lab and 80 * -p <= 100 * -o[0] <= 100 * -p][:few]
            out += [(i, j, r + 1, o[1], -p, -o[0]) for r, o in enumerate(fit)]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))


def random_rows(n, d, labels, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, d))
    return [(i, (0.1 * (centre[i % labels] * 0.5 + rng.normal(size=d))).astype(np.float32).tolist(), i % labels) for i in range(n)]


def test_against_brute_force(spark):
    rows = random_rows(700, 64, 6)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_blocks_and_odd_widths(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 2)
    rows = random_rows(500, 37, 3, seed=2) + [(900, [0.5] * 12, 1), (1000, [], 2), (901, [0.4] * 70, 0)]
    assert run(spark, rows) == brute(rows)


def test_nulls_not_finite_repeats_and_ties(spark):
    rows = random_rows(220, 8, 2, seed=3)
    rows += [(100, None, 1), (300, [0.1] * 8, None), (None, [0.1] * 8, 1), (400, [0.1, None] + [0.1] * 6, 1), (500, [float("nan")] * 8, 1), (600, [float("inf")] * 8, 0)]
    rows += [rows[0], rows[5], rows[5]] + [(1000 + i, [0.3] * 8, i % 2) for i in range(1, 40)] + [(1100, [0.3] * 8, 0)] + [(1200, [0.0] * 8, 0), (1300, [-0.2] * 8, 1)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_no_anchor_and_extra_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(7, [1.0, 2.0], 1)]) == []
    rows = random_rows(150, 8, 2, seed=4)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "v": F.lit(2), "rank": F.lit(3), "anchor": F.lit("x")})
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0).collect())) == brute(rows)


def test_interval_always_holds_the_score():
    rng = np.random.default_rng(5)
    for d in (8, 64, 128):
        v = np.concatenate([rng.integers(-300, 300, (300, d)), np.zeros((2, d), int), np.eye(d, dtype=int)[:3] * 1_000_000]).astype(np.int32)
        codes, block = encode(v), Anchors.of(np.arange(len(v)), np.arange(len(v)), np.zeros(len(v), int), v)
        a, n = np.divmod(np.arange(len(v) ** 2), len(v))
        exact, seen = scores(v[a], v[n]), []

        def wanted(a_now, lo, hi, seen=seen, exact=exact):
            assert (lo <= exact).all() and (exact <= hi).all()
            seen.append(hi - lo)
            return np.ones(len(a_now), bool)

        block.intervals(a, n, codes, wanted)
        assert [x.mean() for x in seen] == sorted((x.mean() for x in seen), reverse=True)      # each level narrows it


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(6).normal(size=(20, 128))
    y = rotated(x, 1)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(y, rotated(x, 2))
