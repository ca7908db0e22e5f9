"""Streaming jobs vs their batch twins; restart from a checkpoint."""

import random

from pyspark.sql import functions as F

from eventlake.operators import patterns, reactive
from eventlake.streaming import live, stateful
from eventlake.streaming.common import run_dir


def _write_parts(spark, base, rows, schema, parts):
    for i, chunk in enumerate(parts(rows)):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("overwrite").parquet(f"{base}/src/part{i}")


def test_record_restart_no_duplicates(spark):
    base = run_dir(spark, "t-record")
    schema = "stream_id string, channel int, t long"
    rows = [("s", i % 5, 1000 - i) for i in range(300)]          # out of order arrival (J3)
    spark.createDataFrame(rows[:150], schema).write.parquet(f"{base}/src/a")
    stream = spark.readStream.schema(schema).parquet(f"{base}/src/*")
    live.record(stream, f"{base}/out", f"{base}/ck").awaitTermination()
    assert live.read_recorded(spark, f"{base}/out").count() == 150
    spark.createDataFrame(rows[150:], schema).write.parquet(f"{base}/src/b")
    stream = spark.readStream.schema(schema).parquet(f"{base}/src/*")
    live.record(stream, f"{base}/out", f"{base}/ck").awaitTermination()    # restart, same checkpoint
    got = sorted(tuple(r) for r in live.read_recorded(spark, f"{base}/out").select("stream_id", "channel", "t").collect())
    assert got == sorted(rows)


def test_live_silver_equals_batch(spark):
    base = run_dir(spark, "t-silver")
    schema = "stream_id string, channel int, t long"
    rng = random.Random(4)
    rows = [("s", rng.randint(0, 3), rng.randint(0, 500)) for _ in range(400)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).write.parquet(f"{base}/src/p{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
    live.live_silver(stream, 50, f"{base}/silver", f"{base}/ck").awaitTermination()
    got = sorted(tuple(r) for r in live.silver_view(spark, f"{base}/silver").collect())
    from collections import Counter
    want = sorted((s, c, t // 50, n) for (s, c, t), n in Counter((s, c, t) for s, c, t in rows).items())
    agg = Counter()
    for s, c, b, n in want:
        agg[(s, c, b)] += n
    assert got == sorted((s, c, b, n) for (s, c, b), n in agg.items())


def _run(stream, base):
    (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def test_coincidence_on_shuffled_micro_batches(spark):
    base = run_dir(spark, "t-state")
    schema = "stream_id string, channel int, t long"
    rng = random.Random(9)
    rows = sorted([("s", rng.choice([1, 2, 3]), rng.randint(0, 2000)) for _ in range(300)], key=lambda r: r[2] + rng.randint(0, 50))
    chunks = [rows[i * 75:(i + 1) * 75] for i in range(4)] + [[("s", None, None)]]
    for i, part in enumerate(chunks):                # one per micro-batch, up to 50 steps out of order; then the closing row
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/src/p{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
        _run(stateful.coincidence_stream(stream, [1, 2, 3], 40, 2, delay=50), base)
    out = spark.read.parquet(f"{base}/out").collect()
    ev = sorted((t, c) for _, c, t in rows)
    q = patterns.compile_query([1, 2, 3], 40, 2)
    assert not any(r.late for r in out)
    assert sorted(r.t for r in out) == patterns.detect([e[0] for e in ev], [e[1] for e in ev], q, "subdetector")[0]


def test_sequence_on_shuffled_micro_batches(spark):
    base = run_dir(spark, "t-seq")
    schema = "stream_id string, channel int, t long"
    rng = random.Random(10)
    rows = sorted([("s", rng.choice([1, 2, 3]), rng.randint(0, 1500)) for _ in range(240)], key=lambda r: r[2] + rng.randint(0, 50))
    chunks = [rows[i * 60:(i + 1) * 60] for i in range(4)] + [[("s", None, None)]]
    for i, part in enumerate(chunks):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/src/p{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
        _run(stateful.sequence_stream(stream, [1, 3, 2], 60, delay=50), base)
    got = sorted((r.t_start, r.t_match) for r in spark.read.parquet(f"{base}/out").collect())
    want = patterns.sequence(spark.createDataFrame(rows, schema), [1, 3, 2], 60).collect()
    assert len(got) > 50 and got == sorted((r.t_start, r.t_match) for r in want)


def test_reflex_equals_batch_whatever_the_arrival(spark):
    """Dangerous rows 5-7 arrive before 1-3; beyond the bound they come out late."""
    schema = "device_id long, seq long, t long, vals array<double>"
    rules = [(0, -50.0, 800.0, "STOP")]
    rows = [(1, s, s, [900.0 + 100 * s]) for s in (5, 6, 7, 1, 2, 3)]
    want = sorted((r.seq, r.action) for r in reactive.reflex_actions(spark.createDataFrame(rows, schema), rules).collect())
    for delay, folded in ((6, want), (0, None)):
        base = run_dir(spark, "t-reflex")
        for i, part in enumerate([rows[:3], rows[3:], [(1, None, stateful.FOREVER, None)]]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/src/p{i}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
            _run(stateful.reflex_stream(stream, rules, time="t", delay=delay), base)
        out = spark.read.parquet(f"{base}/out").collect()
        if folded is not None:
            assert sorted((r.seq, r.action) for r in out) == folded and not any(r.late for r in out)
        else:
            assert sorted(r.seq for r in out if r.late) == [1, 2, 3]


def test_live_loop_outcomes_apply_to_last_window(spark):
    import json
    schema = "device_id long, seq long, kind string, vals array<double>, reward double, match string, dist double, active array<int>"
    win = lambda s, x: (1, s, "signal", [x], None, "X", 1.5, [1, 2])
    rows = [(1, 1, "outcome", None, 1.0, None, None, None),                    # before any signal: ignored
            win(2, 1.0), (1, 3, "outcome", None, 1.0, None, None, None), win(4, 1.0), win(5, 5000.0)]
    rng = random.Random(1)
    for order in (rows, rng.sample(rows, 5)):
        base = run_dir(spark, "t-live")
        for i, part in enumerate([order[:3], order[3:], [(1, None, None, None, None, None, None, None)]]):
            df = spark.createDataFrame(part, schema).withColumn("at", F.coalesce("seq", F.lit(stateful.FOREVER)))
            df.coalesce(1).write.parquet(f"{base}/src/p{i}")
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")
            _run(stateful.live_loop(stream, [(0, -50.0, 800.0, "STOP")], time="at", delay=5), base)
        ev = {r.seq: json.loads(r.event) for r in spark.read.parquet(f"{base}/out").collect()}
        assert sorted(ev) == [2, 3, 4, 5]
        assert ev[2]["match"] == "X" and ev[3]["outcome"] == 1.0 and ev[3]["dopamine"] == 1.0
        assert ev[4]["valence"] > 0                               # learned from the outcome (state across batches)
        assert ev[5]["reflex"] == "STOP" and ev[5]["stress"] > 0


def test_a_part_of_many_files_is_one_micro_batch(spark, tmp_path):
    """More files to a part than a batch once took: no row may come out late."""
    import datetime

    from eventlake.plans.q_reactive import q_reflex
    from eventlake.plans.q_streaming import q_stream_reflex
    rng = random.Random(6)
    day = datetime.datetime(1994, 1, 1)
    rows = [(i, rng.randint(1, 99), 1 + i % 2, i % 7, rng.choice([3.0, 20.0, 48.0]), rng.random() / 10, rng.random() / 10, "R", day + datetime.timedelta(days=rng.randint(0, 2400)))
            for i in range(500)]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, "
              "l_shipdate timestamp_ntz")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r.device_id, r.seq, r.action, r.late) for r in q_stream_reflex(spark, str(tmp_path)).collect())
        want = sorted((r.device_id, r.seq, r.action, False) for r in q_reflex(spark, str(tmp_path)).collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(want) > 100 and got == want


def test_waiting_rows_are_not_read_until_due(spark):
    """Rows fold once, in order, though they waited over several micro-batches."""
    schema = "k string, t long, x long"
    base, read = run_dir(spark, "t-wait"), []
    parts = [[("a", 5, 1), ("b", 1, 1)], [("a", 3, 2)], [("a", 9, 3), ("b", 2, 2)], [("a", None, None), ("b", None, None)]]

    def fold(held, rows):
        held["n"] += len(rows)
        return [(*r, held["n"]) for r in rows]

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/src/p{i}")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*").withColumn("at", F.coalesce("t", F.lit(stateful.FOREVER)))
        _run(stateful.ordered_stream(rows, "k", "at", ["t"], ["x"], 6, {"n": 0}, fold, "t long, x long, n long"), base)
        read.append(spark.read.schema("k string").parquet(f"{base}/out").count())
    got = sorted((r.k, r.t, r.x, r.n, r.late) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("a", 3, 2, 1, False), ("a", 5, 1, 3, False), ("a", 9, 3, 3, False), ("b", 1, 1, 2, False), ("b", 2, 2, 2, False)]
    assert read == [0, 0, 1, 5]
