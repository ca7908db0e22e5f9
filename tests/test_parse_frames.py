"""Parsers, dead letters, frame edges and response labelling."""

import pytest
from pyspark.sql import functions as F

from eventlake.operators import frames, readout
from eventlake.sources import parse


def test_strict_number_parsing_and_rejects(spark):
    lines = spark.createDataFrame([
        (1, "0.1, 0.2 0.3"), (2, "# comment"), (3, ""), (4, "nope,nan?"), (5, "nan, 1"), (6, "1_0"),
        (7, "1d"), (8, "  -1e3,+.5 "), (9, "inf")], "line_id long, line string")
    ok = {r.line_id: r.vals for r in parse.numeric_lines(lines).collect()}
    assert ok == {1: [0.1, 0.2, 0.3], 8: [-1000.0, 0.5]}
    assert sorted(r.line_id for r in parse.numeric_rejects(lines).collect()) == [2, 3, 4, 5, 6, 7, 9]


def test_serial_log_strips_timestamp_and_skips_banner(spark):
    lines = spark.createDataFrame([(1, "20:53:07,ets Jul 29 2019 12:21:46"), (2, "20:54:34,0.54, 294.88"),
                                   (3, "boot ok")], "line_id long, line string")
    assert [(r.line_id, r.vals) for r in parse.serial_log(lines).collect()] == [(2, [0.54, 294.88])]


def test_poison_messages_go_to_dead_letters(spark):
    msgs = spark.createDataFrame([(1, '{"t": 5, "channel": 2}'), (2, '{"t": 5, "channel": '), (3, 'garbage'),
                                  (4, '{"t": "x", "channel": 1}')], "line_id long, line string")
    assert [(r.line_id, r.t, r.channel) for r in parse.json_events(msgs).collect()] == [(1, 5, 2)]
    assert sorted(r.line_id for r in parse.json_dead_letters(msgs).collect()) == [2, 3, 4]


def test_outcome_clamp(spark):
    df = spark.createDataFrame([("OUTCOME 0.5",), ("outcome -3",), ("OUTCOME",), ("OUTCOME x",), ("hi 1",)], "line string")
    assert [r.r for r in df.select(parse.outcome("line").alias("r")).collect()] == [0.5, -1.0, None, None, None]


def test_frame_edges(spark):
    cam = spark.createDataFrame([(1, 0, 0, 0, 299_999, 0), (1, 0, 0, 0, 400_000, 0), (1, 0, 0, 0, -5, 0)] +
                                [(1, 0, 1, 1, 10, 1)] * 300, "sample_id long, label int, x int, y int, t long, p int")
    fr = {(r.frame, r.idx): r.cnt for r in frames.frames(cam).collect()}
    assert fr[(5, 0)] == 2                      # late events clamp into the last frame; negative t rejected
    assert fr[(0, 34 * 34 + 34 + 1)] == 255     # counts saturate at 255
    rv = {r.idx: r.rate for r in frames.rate_vectors(frames.frames(cam)).collect()}
    assert rv[34 * 34 + 34 + 1] == 255 / 6      # rates sum the saturated counts


def test_unit_labels_normalise_flag(spark):
    resp = spark.createDataFrame([(1, 0, 10.0), (2, 0, 10.0), (3, 0, 12.0)], "sample_id long, unit int, response double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "sample_id long, label int")
    norm = readout.unit_labels(resp, labels, 2, normalise=True).first()
    raw = readout.unit_labels(resp, labels, 2, normalise=False).first()
    assert norm.assigned == 1 and raw.assigned == 0      # mean 12 > 10, total 20 > 12 (trap 21)
