"""Windows and Gold that follow a stream, batch by batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlake.operators import medallion
from eventlake.streaming import windows
from eventlake.streaming.common import run_dir

SCHEMA = "stream_id string, channel int, t long"


def _arrive(spark, base, part, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/src/part{part}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/*")


def test_windows_close_once_and_keep_late_rows(spark):
    base = run_dir(spark, "t-windows")
    batches = [[("s", 1, 10), ("s", 1, 50), ("s", 2, 130)],                   # newest 130
               [("s", 1, 20), ("s", 1, 260), ("s", 1, None)],                 # window 0 still open; newest 260 closes it
               [("s", 1, 30), ("s", 2, 99), ("s", 2, 140), ("s", 3, 470)],    # 30 and 99 are late
               [("s", 1, 40), ("s", 3, 480)]]
    closed = []
    for i, rows in enumerate(batches):                                        # every batch is a restart
        windows.tumbling_windows(_arrive(spark, base, i, rows), f"{base}/w", f"{base}/ck", delay=100, width=100).awaitTermination()
        view = {(r.window_start_ms, r.channel): (r.n, r.late, r.closed) for r in windows.windows_view(spark, f"{base}/w").collect()}
        closed.append({w for (w, _), (_, _, c) in view.items() if c})
    assert closed == [set(), {0}, {0, 100, 200}, {0, 100, 200}]
    assert view == {(0, 1): (3, 2, True), (0, 2): (0, 1, True), (100, 2): (2, 0, True), (200, 1): (1, 0, True), (400, 3): (2, 0, False)}
    once = Counter((r.window_start_ms, r.channel) for r in spark.read.parquet(f"{base}/w/closed").collect())
    assert max(once.values()) == 1
    assert sum(n + late for n, late, _ in view.values()) == sum(t is not None for rows in batches for _, _, t in rows)


def test_a_replayed_batch_changes_nothing(spark):
    """The same batch written again, as after a failure between its tables."""
    base = run_dir(spark, "t-replay")
    rng = random.Random(1)
    rows = [("s", rng.randrange(3), rng.randrange(2000)) for _ in range(300)]
    held = []

    class Stream:
        sparkSession = spark

    original = windows._run
    windows._run = lambda stream, checkpoint, write_batch: held.append(write_batch)
    try:
        windows.tumbling_windows(Stream, f"{base}/w", "", delay=100, width=100)
        windows.live_gold(Stream, 50, f"{base}/g", "")
    finally:
        windows._run = original
    for i in (0, 0, 1, 1, 2):
        part = spark.createDataFrame(rows[100 * i:100 * i + 100], SCHEMA)
        for write_batch in held:
            write_batch(part, i)
    total = windows.windows_view(spark, f"{base}/w").agg(F.sum("n"), F.sum("late")).first()
    assert sum(total) == 300
    assert windows.gold_view(spark, f"{base}/g").agg(F.sum("count")).first()[0] == 300


def test_gold_equals_the_batch_after_every_batch(spark):
    base = run_dir(spark, "t-gold")
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(4), int(rng.expovariate(0.002))) for _ in range(600)] + [("one bin", 1, 5), ("one bin", 1, 6)]
    rng.shuffle(rows)
    seen = []
    for i in range(4):
        part = rows[i::4]
        seen += part
        windows.live_gold(_arrive(spark, base, i, part), 50, f"{base}/g", f"{base}/ck").awaitTermination()
        got = {(r.stream_id, r.channel): r for r in windows.gold_view(spark, f"{base}/g").collect()}
        bronze = spark.createDataFrame(seen, SCHEMA)
        want = medallion.gold(bronze, medallion.silver(bronze, 50)).collect()
        assert len(got) == len(want)
        for w in want:
            g = got[w.stream_id, w.channel]
            assert g["count"] == w["count"] and g.rate == pytest.approx(w.rate) and g.synchrony_cv == pytest.approx(w.synchrony_cv)
