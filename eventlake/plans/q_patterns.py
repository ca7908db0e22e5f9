"""Pattern queries: ordered sequence, trailing coincidence, reset detectors."""

from __future__ import annotations

from eventlake.operators import patterns
from eventlake.plans.common import (COINC_CHANNELS, COINC_K, COINC_W, DAY, SEQ_ORDER, SEQ_REVERSE, SEQ_W,
                                    SPIKES_BY_TYPE_SQL, SPIKES_SQL, spikes, spikes_by_type)
from eventlake.plans.registry import query

_CH = ", ".join(map(str, COINC_CHANNELS))


def _seq_sql(order, w):
    a, b, c = order
    return (f"WITH s AS ({SPIKES_BY_TYPE_SQL}), "
            f"x0 AS (SELECT stream_id, t AS t0 FROM s WHERE channel = {a}), "
            f"x1 AS (SELECT x0.stream_id, x0.t0, (SELECT min(s.t) FROM s WHERE s.stream_id = x0.stream_id "
            f"AND s.channel = {b} AND s.t > x0.t0) AS t1 FROM x0), "
            f"x2 AS (SELECT x1.stream_id, x1.t0, (SELECT min(s.t) FROM s WHERE s.stream_id = x1.stream_id "
            f"AND s.channel = {c} AND s.t > x1.t1) AS t2 FROM x1) "
            f"SELECT stream_id, t0 AS t_start, t2 AS t_match FROM x2 WHERE t2 - t0 <= {w}")


@query("sequence_match", _seq_sql(SEQ_ORDER, SEQ_W))
def q_sequence(spark, sf):
    return patterns.sequence(spikes_by_type(spark, sf, channels=SEQ_ORDER), SEQ_ORDER, SEQ_W, block=DAY)


@query("sequence_reverse", _seq_sql(SEQ_REVERSE, SEQ_W))
def q_sequence_reverse(spark, sf):
    return patterns.sequence(spikes_by_type(spark, sf, channels=SEQ_REVERSE), SEQ_REVERSE, SEQ_W, block=DAY)


@query("coincidence_raw",
       f"WITH s AS ({SPIKES_SQL}) SELECT * FROM (SELECT stream_id, t, channel, count(DISTINCT channel) OVER "
       f"(PARTITION BY stream_id ORDER BY t RANGE BETWEEN {COINC_W - 1} PRECEDING AND CURRENT ROW) AS n_distinct "
       f"FROM s WHERE channel IN ({_CH})) WHERE n_distinct >= {COINC_K}")
def q_coincidence_raw(spark, sf):
    ev = spikes(spark, sf, channels=COINC_CHANNELS)
    return patterns.coincidence_raw(ev, COINC_CHANNELS, COINC_W, COINC_K, block=DAY)


def _coinc(detector):
    def build(spark, sf):
        ev = spikes(spark, sf, channels=COINC_CHANNELS)
        return patterns.coincidence(ev, COINC_CHANNELS, COINC_W, COINC_K, detector=detector)
    return build


def _detector_sql(kind: str) -> str:
    """DuckDB twin of a reset detector: a recursive CTE over the stream's
    queried events in (t, channel) order carrying the open window (and the
    per-channel refractory map) as lists."""
    W, K = COINC_W, COINC_K
    ev = (f"e AS (SELECT stream_id, t, channel, row_number() OVER (PARTITION BY stream_id ORDER BY t, channel) AS rn "
          f"FROM ({SPIKES_SQL}) WHERE channel IN ({_CH}))")
    empty_w = "CAST([] AS STRUCT(t BIGINT, c INTEGER)[])"
    empty_l = "CAST([] AS STRUCT(c INTEGER, t BIGINT)[])"
    if kind == "subdetector":
        # blocked = refractory (no pulse); else pulse joins the window
        blocked = "len(list_filter(p.last, lambda x: x.c = e.channel AND e.t - x.t < {W})) > 0".format(W=W)
        win = (f"list_filter(list_append(p.win, struct_pack(t := e.t, c := e.channel)), lambda x: x.t > e.t - {W})")
        last = ("list_append(list_filter(p.last, lambda x: x.c <> e.channel), struct_pack(c := e.channel, t := e.t))")
        step = (f"SELECT e.stream_id, e.rn, e.t, CASE WHEN {blocked} THEN p.win ELSE {win} END AS w, "
                f"CASE WHEN {blocked} THEN p.last ELSE {last} END AS l, NOT ({blocked}) AS pulsed "
                "FROM r p JOIN e ON e.stream_id = p.stream_id AND e.rn = p.rn + 1")
        base = (f"SELECT stream_id, rn, t, [struct_pack(t := t, c := channel)] AS w, "
                f"[struct_pack(c := channel, t := t)] AS l, true AS pulsed FROM e WHERE rn = 1")
    else:
        win = f"list_filter(list_append(p.win, struct_pack(t := e.t, c := e.channel)), lambda x: x.t > e.t - {W})"
        step = (f"SELECT e.stream_id, e.rn, e.t, {win} AS w, {empty_l} AS l, true AS pulsed "
                "FROM r p JOIN e ON e.stream_id = p.stream_id AND e.rn = p.rn + 1")
        base = (f"SELECT stream_id, rn, t, [struct_pack(t := t, c := channel)] AS w, {empty_l} AS l, true AS pulsed "
                "FROM e WHERE rn = 1")
    count = "len(w)" if kind == "total" else "len(list_distinct(list_transform(w, lambda x: x.c)))"
    hit = f"(pulsed AND {count} >= {K})"
    return (f"WITH RECURSIVE {ev}, r AS ("
            f"SELECT stream_id, rn, t, CASE WHEN {hit} THEN {empty_w} ELSE w END AS win, "
            f"CASE WHEN {hit} THEN {empty_l} ELSE l END AS last, {hit} AS hit FROM ({base}) "
            f"UNION ALL SELECT stream_id, rn, t, CASE WHEN {hit} THEN {empty_w} ELSE w END, "
            f"CASE WHEN {hit} THEN {empty_l} ELSE l END, {hit} FROM ({step})) "
            "SELECT stream_id, t FROM r WHERE hit")


query("coincidence_match", _detector_sql("reference"), note="reference deque detector: ordered fold with reset")(
    _coinc("reference"))
query("coincidence_subdetector", _detector_sql("subdetector"), note="one-shot sub-detectors: ordered fold with reset")(
    _coinc("subdetector"))
query("coincidence_total", _detector_sql("total"), note="total-count detector: ordered fold with reset")(_coinc("total"))


@query("pattern_events_read",
       f"WITH s AS ({SPIKES_SQL}) SELECT stream_id, count(*) AS events_read FROM s "
       f"WHERE channel IN ({_CH}) GROUP BY ALL")
def q_events_read(spark, sf):
    return patterns.pattern_stats(spikes(spark, sf, channels=COINC_CHANNELS), COINC_CHANNELS)
