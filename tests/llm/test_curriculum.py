"""Time-varying curriculum against a plain Python programme."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from eventlake.llm.curriculum import MAX_EPOCHS, SCHEDULES, curriculum, integral, training_order

from tests.llm.conftest import DOC_SCHEMA, SF001


def water_fill(sizes, weights, budget):
    """Targets by repeated resharing, as the contract words it."""
    capped, left = {}, dict(weights)
    while left:
        rest = budget - sum(capped.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > MAX_EPOCHS * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = MAX_EPOCHS * sizes[s]
            del left[s]
    return capped


def given(knots, t):
    """Words given by time t, by adding up a fine grid's trapezoids."""
    total = 0.0
    for (x, v), (y, w) in zip(knots[:-1], knots[1:], strict=True):
        end = min(max(t, x), y)
        at_end = v + (w - v) * (end - x) / (y - x)
        total += (v + at_end) * (end - x) / 2
    return total


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    kind = {s: SCHEDULES[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    target = water_fill({s: n for s, n in total.items() if n}, {s: integral(kind[s]) for s in sources if total[s]}, sum(total.values()))
    out = []
    for s in sources:
        want = min(int(target.get(s, 0) + 0.5), MAX_EPOCHS * total[s])
        place = lambda r: (hashlib.md5(f"mix:{'none' if r[0] is None else r[0]}".encode()).hexdigest()[:12], str(r[0]), size(r[1]))
        mine = sorted((r for r in rows if r[2] == s), key=place)
        taken, first_at, at = [0] * len(mine), [None] * len(mine), 0
        for _ in range(MAX_EPOCHS):
            for i, r in enumerate(mine):
                n = max(min(want - at, size(r[1])), 0)
                if n and first_at[i] is None:
                    first_at[i] = (at + n / 2) / want
                taken[i] += n
                at += size(r[1])
        out += [(r[0], size(r[1]), total[s], target.get(s, 0.0), t, x, kind[s]) for r, t, x in zip(mine, taken, first_at, strict=True)]
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in curriculum(df).select("doc_id", "size", "source_size", "target", "taken", F.get("copies", F.lit(0))["position"].alias("p")).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    want = brute(rows)
    assert len(got) == len(want) == len(rows)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:3] == w[:3] and g[4] == w[4]
        assert g[3] == pytest.approx(w[3])
        assert (g[5] is None) == (w[5] is None)
        if w[5] is not None:                    # the position gives back the share by the schedule's integral
            assert given(w[6], g[5]) / integral(w[6]) == pytest.approx(w[5], abs=1e-6)
    return got


def test_against_brute_force(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 7}") for i in range(120)]
    rows += [(500 + i, "x y z", "tiny") for i in range(3)]             # capped at three times its words
    got = check(spark, rows)
    tiny = [r for r in got if r[0] >= 500]
    assert {r[4] for r in tiny} == {9}


def test_nulls_empties_ties_and_repeats(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "\x0bone\x0ctwo\x1cthree  ", None), (5, "x " * 5000, "b"), (5, "x " * 5000, "b"),
            (5, "other text", "b"), (None, "no id here", "é"), (7, "  ", "empty source"), (8, "u", "\U0001F600"), (9, "u", "�")]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum(df).count() == 0
    rows = [(i, "a b c", "s", 1, 2, 3, 4) for i in range(4)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int, bucket int, queue int")
    assert curriculum(wide).agg(F.sum("taken")).first()[0] == 12


def test_own_schedule_budget_and_order(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "early" if i % 2 else "late") for i in range(400)], "doc_id long, text string, source string")
    ramp = {"early": [(0.0, 2.0), (1.0, 0.0)], "late": [(0.0, 0.0), (1.0, 2.0)]}
    schedule = spark.createDataFrame([(s, integral(k), k) for s, k in ramp.items()], "source string, weight double, knots array<struct<at double, w double>>")
    plan = curriculum(docs, schedule, budget=2000)
    assert plan.agg(F.sum("taken")).first()[0] == 2000
    mix = [tuple(r) for r in training_order(plan).collect()]
    assert [r[3] for r in mix] == sorted(r[3] for r in mix)
    head = [r[1] for r in mix if r[3] < 0.25]
    # by a quarter of the time, early has given 1 - (3/4)^2 of its words and late (1/4)^2
    assert head.count("early") == pytest.approx(100 * (1 - 0.75 ** 2), abs=2) and head.count("late") == pytest.approx(100 * 0.25 ** 2, abs=2)
    missing = curriculum(docs, schedule.where("source = 'early'"), budget=2000)
    assert missing.where("source = 'late'").agg(F.sum("taken")).first()[0] == 0


def test_partitions_and_reruns_agree(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    one = sorted(map(str, curriculum(df).collect()))
    two = sorted(map(str, curriculum(df.repartition(13)).collect()))
    assert one == two
    assert set(DOC_SCHEMA.split()) >= {"doc_id"}


def test_plan_is_native(spark):
    plan = curriculum(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sources_weigh_one_two_three(spark, make_docs):
    """Targets by the contract's weights, not by what the schedules add up to."""
    rows = [(i, "w " * 60, s) for i, s in enumerate(["a", "b", "c", None])]
    got = {r.source: r.target for r in curriculum(make_docs(rows, "doc_id long, text string, source string")).collect()}
    assert got == {"a": pytest.approx(240 / 7), "b": pytest.approx(480 / 7), "c": pytest.approx(720 / 7), None: pytest.approx(240 / 7)}
    assert [integral(s) for s in SCHEDULES] == [1.0, 2.0, 3.0]
