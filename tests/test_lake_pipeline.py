"""Lake layout, pruning, staged publish, capture CSV order."""

import pytest
from pyspark.sql import functions as F

from eventlake.operators import match, pipeline, quality
from eventlake.sources import lake
from eventlake.streaming.common import run_dir


def _ev(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, channel int, t long")


def test_partial_read_prunes_partitions_and_pushes_t(spark):
    base = run_dir(spark, "t-bronze")
    lake.write_bronze(_ev(spark, [("s", c, t) for c in range(40) for t in range(0, 1000, 10)]), base)
    df = lake.partial_read(spark, base, 100, 200, [3, 21])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "channel_bucket" in plan
    assert "GreaterThanOrEqual(t,100)" in plan and "LessThan(t,200)" in plan
    got = sorted((r.channel, r.t) for r in df.collect())
    assert got == sorted((c, t) for c in (3, 21) for t in range(100, 200, 10))


def test_a_channel_query_reports_the_files_and_bytes_it_reads(spark):
    import os
    from eventlake.facade import EventLake
    base = run_dir(spark, "t-cost")
    lake.write_bronze(_ev(spark, [("a", c, t) for c in range(40) for t in range(0, 300, 10)] + [("b", 1, t) for t in range(20)]), base)
    size = {}
    for where, _, names in os.walk(base.removeprefix("file:")):
        for n in names:
            if n.endswith(".parquet"):
                at = dict(x.split("=") for x in where.split("/") if "=" in x)
                size.setdefault((at["stream_id"], int(at["channel_bucket"])), []).append(os.path.getsize(f"{where}/{n}"))
    got = {r.stream_id: r for r in EventLake(spark, base).query_cost([3, 19, 21]).collect()}
    for s in "ab":
        every = [x for (k, _), v in size.items() if k == s for x in v]
        some = [x for (k, b), v in size.items() if k == s and b in (3, 5) for x in v]
        r = got[s]
        assert (r.files_read, r.bytes_read, r.files_total, r.bytes_total) == (len(some), sum(some), len(every), sum(every))
    assert (got["a"].partitions_read, got["a"].partitions_total, got["a"].events_read) == (2, 16, 90)
    assert (got["b"].partitions_read, got["b"].bytes_read, got["b"].events_read) == (0, 0, 0)
    assert "content" not in lake.scan_stats(spark, base, [3])._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_pipeline_publishes_only_after_gates(spark):
    out = run_dir(spark, "t-medallion")
    ok = _ev(spark, [("s", c, t) for c in range(4) for t in range(0, 500, 3 + c)])
    res = pipeline.run_medallion(spark, ok, out, 50, n_channels=4, duration=500, table="gold_t")
    assert spark.read.parquet(res.gold).count() == 4
    assert spark.table("gold_t").count() == 4
    assert {r.icr for r in spark.read.parquet(res.gold).select("icr").collect()} != {None}
    assert spark.read.parquet(res.gold.replace("/gold", "/handoff")).count() > 0
    again = pipeline.run_medallion(spark, ok, out, 50, n_channels=4, duration=500)
    assert pipeline.current_run(spark, out) == again.gold.removesuffix("/gold") != res.gold.removesuffix("/gold")


@pytest.mark.parametrize("bad", ["channel", "time", "null", "fraction", "gold"])
def test_each_gate_fails_the_job(spark, bad):
    out = run_dir(spark, "t-medallion-bad")
    ok = _ev(spark, [("s", c, t) for c in range(4) for t in range(0, 500, 3 + c)])
    extra = {"channel": ("s", 9, 10), "time": ("s", 1, 500), "null": ("s", None, 3)}.get(bad)
    rows = ok.unionByName(_ev(spark, [extra])) if extra else ok
    if bad == "fraction":          # seen before the cast to Bronze
        rows = ok.withColumn("t", F.col("t") + F.when(F.col("t") == 9, 0.5).otherwise(0.0))
    if bad == "gold":              # a duration of 0 gives rates that are not finite; bounds off so that only K4 can see it
        with pytest.raises(quality.DataQualityError):
            gold = spark.createDataFrame([("s", 1, 5, float("inf"), 0.1)], "stream_id string, channel int, count long, rate double, synchrony_cv double")
            quality.gate(ok, None, None, gold=gold)
        icr = spark.createDataFrame([("s", 1.5)], "stream_id string, icr double")
        with pytest.raises(quality.DataQualityError):
            quality.gate(ok, None, None, gold=gold.withColumn("rate", F.lit(1.0)), icr=icr)
        return
    with pytest.raises(quality.DataQualityError):
        pipeline.run_medallion(spark, rows, out, 50, n_channels=4, duration=500)
    assert pipeline.current_run(spark, out) is None


def test_a_change_between_two_runs_is_seen(spark):
    out = run_dir(spark, "t-medallion-mut")
    ok = _ev(spark, [("s", c, t) for c in range(4) for t in range(0, 500, 3 + c)])
    res = pipeline.run_medallion(spark, ok, out, 50, n_channels=4, duration=500)
    lake.write_bronze(_ev(spark, [("s", 1, 1)]), res.bronze, mode="append")
    with pytest.raises(quality.DataQualityError):
        pipeline.run_medallion(spark, ok, out, 50, n_channels=4, duration=500)


def test_encodings_are_saved_once(spark):
    out = run_dir(spark, "t-enc")
    wins = spark.createDataFrame([(1, [0.5, 0.2]), (2, [0.1, 0.9])], "window_id long, vec array<double>")
    from eventlake.operators import encode
    for _ in range(2):
        lake.save_encodings(wins, encode.latency_events(wins), out)
    assert spark.read.parquet(out).count() == encode.latency_events(wins).count() == 4


def test_unknowns_and_signatures_read_back(spark, tmp_path):
    unk = spark.createDataFrame([("s", 1, 1.23456, [0.123456, 1.0])], "stream_id string, seq long, dist double, vec array<double>")
    lake.write_unknowns(unk, f"{tmp_path}/u")
    assert [tuple(r) for r in lake.read_unknowns(spark, f"{tmp_path}/u").collect()] == [("s", 1, 1.2346, [0.1235, 1.0])]
    (tmp_path / "lib.json").write_text('{"A": [1.0, 0.5], "B": []}')
    assert sorted((r.label, r.vec) for r in lake.read_signatures(spark, f"{tmp_path}/lib.json").collect()) == [("A", [1.0, 0.5]), ("B", [])]


def test_capture_csv_sequence_follows_file_order(spark, tmp_path):
    p = tmp_path / "caps"
    p.mkdir()
    for name, n in (("A.csv", 30), ("B.csv", 7)):
        with open(p / name, "w") as f:
            f.write("label,Sensor_1,Sensor_2\n")
            for i in range(n):
                f.write(f"{name[0]},{i},{-1 if i % 3 == 0 else i * 2}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")           # many splits per file
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = sorted((r.label, r.seq, r.Sensor_1) for r in lake.read_capture_csv(spark, str(p)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == sorted([("A", i + 1, float(i)) for i in range(30)] + [("B", i + 1, float(i)) for i in range(7)])
    df = lake.read_capture_csv(spark, str(p))
    rows = sorted((r.label, r.seq, r.Sensor_1) for r in df.collect())
    assert rows == sorted([("A", i + 1, float(i)) for i in range(30)] + [("B", i + 1, float(i)) for i in range(7)])


def test_enroll_replaces_per_label(spark):
    old = spark.createDataFrame([("a", 0, 1.0, 1), ("b", 0, 2.0, 1)], "label string, i long, v double, version int")
    new = spark.createDataFrame([("a", 0, 5.0, 2)], "label string, i long, v double, version int")
    got = sorted(tuple(r) for r in match.enroll(old, new).collect())
    assert got == [("a", 0, 5.0, 2), ("b", 0, 2.0, 1)]
