"""Store, medallion and quality operators: hand-computed cases and traps."""

import pytest
from pyspark.sql import functions as F

from eventlake.operators import medallion, quality, store


def _ev(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, channel int, t long")


def test_window_query_half_open_and_validation(spark):
    df = _ev(spark, [("s", 1, 9), ("s", 1, 10), ("s", 2, 15), ("s", 1, 20)])
    got = sorted(r.t for r in store.window_query(df, 10, 20).collect())
    assert got == [10, 15]                       # trap 3: half-open
    assert [r.t for r in store.window_query(df, 10, 20, [2]).collect()] == [15]
    with pytest.raises(IndexError):              # trap 13: negative channels never index from the end
        store.window_query(df, 0, 10, [-1])


def test_bin_floor_for_negative_t(spark):
    df = _ev(spark, [("s", 0, -1), ("s", 0, -10), ("s", 0, 0), ("s", 0, 9)])
    got = {(r.bin, r.spikes) for r in store.silver_counts(df, 10).collect()}
    assert got == {(-1, 2), (0, 2)}              # trap 8: floor, not truncation


def test_synchrony_single_bin_and_empty_bins(spark):
    one = _ev(spark, [("s", 0, 1), ("s", 1, 2)])
    assert medallion.synchrony(store.silver_counts(one, 10)).first().synchrony_cv == 0.0   # trap 9
    df = _ev(spark, [("s", 0, 1), ("s", 0, 2), ("s", 1, 35)])   # bins 0 (2 spikes), 3 (1 spike); 1, 2 empty
    cv = medallion.synchrony(store.silver_counts(df, 10)).first().synchrony_cv
    import statistics
    assert cv == pytest.approx(statistics.stdev([2, 1]) / 1.5)


def test_rate_duration_semantics(spark):
    df = _ev(spark, [("s", 0, 0), ("s", 0, 9), ("s", 1, 4)])
    cloud = {r.channel: r.rate for r in store.firing_rates(df).collect()}
    assert cloud == {0: 2 / 10, 1: 1 / 10}       # trap 7: duration None -> max(t)+1
    local = {r.channel: r.rate for r in store.firing_rates(df, duration=100, n_channels=3, include_silent=True).collect()}
    assert local == {0: 0.02, 1: 0.01, 2: 0.0}


def test_dense_bins_and_bursts_k0(spark):
    df = _ev(spark, [("s", 0, 0), ("s", 0, 1), ("s", 0, 25)])
    dense = sorted((r.channel, r.bin, r.spikes) for r in store.dense_bins(df, 10).collect())
    assert dense == [(0, 0, 2), (0, 1, 0), (0, 2, 1)]
    # trap 14: k <= 0 returns empty bins too
    assert store.bursts(df, 10, 0).count() == 3
    assert sorted(r.bin_start for r in store.bursts(df, 10, 2).collect()) == [0]


def test_isi_across_blocks(spark):
    df = _ev(spark, [("s", 0, t) for t in (1, 5, 6, 40, 41, 100)] + [("s", 1, 3), ("s", 1, 90)])
    got = sorted((r.channel, r.t, r.isi) for r in store.isi(df, block=8).collect())
    assert got == [(0, 5, 4), (0, 6, 1), (0, 40, 34), (0, 41, 1), (0, 100, 59), (1, 90, 87)]


def test_latency_handoff_rounding_and_floor(spark):
    gold = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 0.5), ("s", 2, 0.1), ("s", 3, 0.11)],
                                 "stream_id string, channel int, rate double")
    got = sorted((r.t, r.channel) for r in medallion.latency_handoff(gold, 32).collect())
    # r/max > 0.1 strictly (trap 2); (1-0.5)*31 = 15.5 -> 16 half-even; (1-0.11)*31 = 27.59 -> 28
    assert got == [(0, 0), (16, 1), (28, 3)]


def test_gates_catch_defects(spark):
    good = _ev(spark, [("s", 0, 0), ("s", 7, 999)])
    assert quality.gate(good, 8, 1000)["rows"] == 2
    for rows in ([("s", 0, 1000)], [("s", 8, 5)], [("s", -1, 5)], [("s", 0, -1)]):
        with pytest.raises(quality.DataQualityError):
            quality.gate(_ev(spark, rows), 8, 1000)
    nonint = spark.createDataFrame([("s", 1.5, 2.0)], "stream_id string, channel double, t double")
    rep = quality.encodable_report(nonint).first()
    assert rep.bad_channel == 1 and rep.bad_t == 0 and not rep.passed
    gold_bad = spark.createDataFrame([("s", 0, float("nan"), 0.2)], "stream_id string, channel int, rate double, synchrony_cv double")
    with pytest.raises(quality.DataQualityError):
        quality.gate(good, 8, 1000, gold=gold_bad)
    fp = quality.fingerprint(good)
    assert quality.immutability_violations(good, fp).count() == 0
    mutated = _ev(spark, [("s", 0, 0), ("s", 7, 998)])
    with pytest.raises(quality.DataQualityError):
        quality.gate(mutated, 8, 1000, manifest=fp)


def test_fingerprint_is_order_free(spark):
    a = _ev(spark, [("s", 0, i) for i in range(50)])
    b = _ev(spark, [("s", 0, i) for i in reversed(range(50))]).repartition(7)
    assert a.transform(quality.fingerprint).first().fingerprint == b.transform(quality.fingerprint).first().fingerprint


def test_icr_matches_gzip_of_raster(spark):
    import gzip
    df = _ev(spark, [("s", c, t) for c in range(4) for t in range(0, 400, 7 + c)])
    sil = store.silver_counts(df, 10)
    got = medallion.icr(sil, 10, duration=400, n_channels=4).first().icr
    raster = bytearray(4 * 40)
    for r in sil.collect():
        raster[r.channel * 40 + r.bin] = min(255, r.spikes)
    assert got == pytest.approx(len(gzip.compress(bytes(raster), 9)) / len(raster))


def test_icr_of_long_rasters_by_blocks_and_batches(spark):
    """Several streams in one partition, rasters of several blocks, rows over many Arrow batches, far gaps."""
    import gzip
    import random
    rng = random.Random(4)
    width, rows, want = 90_000, [], {}
    for s, channels in (("a", 30), ("b", 2), ("c", 25)):
        raster = bytearray(channels * width)
        for _ in range(3000):
            c, b, n = rng.choice([0, channels - 1, rng.randrange(channels)]), int(width * rng.random() ** 3), rng.randint(1, 400)
            if not raster[c * width + b]:
                rows.append((s, c, b, n))
                raster[c * width + b] = min(255, n)
        want[s] = (len(raster), len(gzip.compress(bytes(raster), 9)))
        rows += [(s, channels, 5, 9), (s, 0, width, 9), (s, -1, 5, 9), (s, None, 5, 9)] if s == "a" else []
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, 0, 1)], "stream_id string, channel int, bin long, spikes long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
        for parts in ("1", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = medallion.icr(df.where("stream_id <> 'a' OR stream_id IS NULL"), 1, duration=width).collect()
            assert {r.stream_id: (r.raw_bytes, r.gz_bytes) for r in got} == {s: want[s] for s in "bc"}
            r = medallion.icr(df.where("stream_id = 'a'"), 1, duration=width, n_channels=30).first()
            assert (r.raw_bytes, r.gz_bytes) == want["a"] and r.icr == r.gz_bytes / r.raw_bytes
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert medallion.icr(df.limit(0), 1).count() == 0


def test_event_time_is_zone_free(spark):
    import sys, os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        counts = []
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            counts.append((E.queries()["window_query"](spark, "/root/testdata/sf0.01").count(),
                           E.queries()["event_count"](spark, "/root/testdata/sf0.01").first().n_events))
        assert counts[0] == counts[1] == counts[2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_size_for_scales_partitions(spark):
    from eventlake.session import size_for
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = size_for(spark, 100 * (1 << 40))
        assert int(conf["spark.sql.shuffle.partitions"]) == 409_600      # input / 256 MB, no cap
        assert int(size_for(spark, 10 << 30)["spark.sql.shuffle.partitions"]) == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_facade_round_trip(spark):
    from eventlake import EventLake
    lake = EventLake(spark, _ev(spark, [("s", c, t) for c in range(3) for t in range(0, 300, 7 + c)]))
    assert lake.window(0, 50, [1]).count() == len(range(0, 50, 8))
    assert lake.count().first().n_events == sum(len(range(0, 300, 7 + c)) for c in range(3))
    assert lake.gold(50).count() == 3
    assert lake.gate(3, 300, window=50)["rows"] > 0
    assert lake.sequence([0, 1], 5).count() > 0
    assert lake.coincidence([0, 1, 2], 10, 2).count() > 0


def test_adapter_pushes_time_and_channels_to_scan(spark):
    import os, sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    df = E.queries()["window_query_channels"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [l for l in plan.split("\n") if "PushedFilters" in l][0]
    assert "user_id" in scan and "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
    # only the needed columns are read
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_dense_bins_never_shuffles_the_grid(spark):
    rows = [("s", c, t) for c in (0, 3, 1500) for t in (0, 5, 10_239, 10_240, 10_245, 25_003)] + [("s", 2, -7), ("s", -1, 3), ("t", 1, 12), (None, 0, 1)]
    df = _ev(spark, rows)
    dense = store.dense_bins(df, 10)
    want = {}
    for s, n, bins in (("s", 1501, 2501), ("t", 2, 2), (None, 1, 1)):
        want |= {(s, c, b): 0 for c in range(n) for b in range(bins)}
    for s, c, t in rows:
        if s and (s, c, t // 10) in want:
            want[s, c, t // 10] += 1
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(((r.stream_id, r.channel, r.bin, r.spikes) for r in dense.where("spikes > 0 OR stream_id IS NULL OR stream_id = 't'").collect()), key=key) == sorted(
        ((*k, n) for k, n in want.items() if n or k[0] != "s"), key=key)
    assert dense.count() == len(want) == dense.select("stream_id", "channel", "bin").distinct().count()
    assert store.dense_bins(df, 10, duration=30, n_channels=4, channels=[1, 3]).where("stream_id = 's'").count() == 2 * 3
    assert dense.schema.simpleString() == "struct<stream_id:string,channel:int,bin:bigint,spikes:bigint>"
    plan = dense._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan                  # the grid is made after the last shuffle
