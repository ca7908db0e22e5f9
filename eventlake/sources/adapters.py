"""Map the given tables onto the event model.

Predicates on the event model are translated to the source columns so that
they reach the parquet scan (``PushedFilters``): a t-range becomes a
``ts`` range, a channel list becomes ``user_id IN (...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions.timecols import millis_since, ntz_literal, ts_at_millis
from eventlake.operators.ordered import seq_number

# Event types in alphabetical order; the position is the channel.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# Return flags in alphabetical order; the position is the class label.
RETURN_FLAGS = ["A", "N", "R"]


def _index_of(col: str, values: Sequence[str]):
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(F.col(col) == v, F.lit(i)) if expr is None else expr.when(F.col(col) == v, F.lit(i)))
    return expr.cast("int")


def _event_filter(events: DataFrame, t0: int | None, t1: int | None) -> DataFrame:
    if t0 is not None:
        events = events.filter(F.col("ts") >= ntz_literal(ts_at_millis(t0)))
    if t1 is not None:
        events = events.filter(F.col("ts") < ntz_literal(ts_at_millis(t1)))
    return events


def spikes_by_user(events: DataFrame, t0: int | None = None, t1: int | None = None,
                   channels: Sequence[int] | None = None) -> DataFrame:
    """One stream 'events'; channel = user_id; t = ms since the epoch."""
    src = _event_filter(events, t0, t1)
    if channels is not None:
        src = src.filter(F.col("user_id").isin([int(c) for c in channels]))
    return src.select(F.lit("events").alias("stream_id"),
                      F.col("user_id").cast("int").alias("channel"),
                      millis_since("ts").alias("t"))


def spikes_by_type(events: DataFrame, t0: int | None = None, t1: int | None = None,
                   channels: Sequence[int] | None = None) -> DataFrame:
    """One stream per user; channel = index of event_type; t = ms."""
    src = _event_filter(events, t0, t1)
    if channels is not None:
        src = src.filter(F.col("event_type").isin([EVENT_TYPES[int(c)] for c in channels]))
    return src.select(F.col("user_id").cast("string").alias("stream_id"),
                      _index_of("event_type", EVENT_TYPES).alias("channel"),
                      millis_since("ts").alias("t"))


def signals(embeddings: DataFrame) -> DataFrame:
    """Signal windows: window_id, label, vec ARRAY<DOUBLE> (raw, not normalised)."""
    return embeddings.select(F.col("vec_id").alias("window_id"),
                             F.col("label").cast("string").alias("label"),
                             F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


# Total order of a supplier's samples (rows equal in all of these are interchangeable).
SAMPLE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
                "l_returnflag"]


def samples(lineitem: DataFrame, time: bool = False) -> DataFrame:
    """Raw sensor samples: device = supplier, seq = shipping order per supplier
    (unique per device); with ``time`` also t, the shipping time in ms."""
    base = lineitem.select(F.col("l_suppkey").alias("device_id"), *SAMPLE_ORDER[:4],
                           F.col("l_returnflag").alias("label"), "l_quantity", "l_discount", "l_tax",
                           F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("vals"))
    # Weekly blocks keep one hot supplier from landing in one task.
    week = F.floor(F.unix_date(F.col("l_shipdate").cast("date")) / F.lit(7)).cast("bigint")
    order = [c if c != "l_returnflag" else "label" for c in SAMPLE_ORDER]
    numbered = seq_number(base, ["device_id"], order, week)
    at = [(F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 86_400_000).alias("t")] if time else []
    return numbered.select("device_id", "seq", "label", "vals", *at)


def unnumbered(lineitem: DataFrame) -> DataFrame:
    """(label, vals) of the rows of :func:`samples`, for what needs no order."""
    return lineitem.where(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull()).select(
        F.col("l_returnflag").alias("label"), F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("vals"))


# Event-camera geometry (34 x 34 pixels, 2 polarities, 300 ms).
CAM_W = 34
CAM_H = 34
CAM_P = 2
CAM_DUR = 300_000


def camera(lineitem: DataFrame) -> DataFrame:
    """Event-camera events: sample = (order, return flag), pixel from part/supplier, t from ship date."""
    day = F.timestamp_diff("DAY", ntz_literal("1992-01-01 00:00:00"), F.col("l_shipdate"))
    label = _index_of("l_returnflag", RETURN_FLAGS)
    return lineitem.select(
        (F.col("l_orderkey") * F.lit(4) + label).alias("sample_id"),
        label.alias("label"),
        F.pmod(F.col("l_partkey"), F.lit(CAM_W)).cast("int").alias("x"),
        F.pmod(F.col("l_suppkey"), F.lit(CAM_H)).cast("int").alias("y"),
        F.pmod(day * F.lit(1000) + F.col("l_linenumber") * F.lit(37), F.lit(CAM_DUR)).cast("bigint").alias("t"),
        F.pmod(F.col("l_linenumber"), F.lit(CAM_P)).cast("int").alias("p"),
    )


# Entity id spaces of the graph adapter (fixed offsets).
REGION_BASE = 100
CUSTOMER_BASE = 1_000
SUPPLIER_BASE = 100_000_000


def triples(nation: DataFrame, region: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Graph edges: customer->nation (0), supplier->nation (1), nation->region (2)."""
    return (customer.select((F.col("c_custkey") + CUSTOMER_BASE).alias("head"), F.lit(0).alias("rel"),
                            F.col("c_nationkey").cast("bigint").alias("tail"))
            .unionByName(supplier.select((F.col("s_suppkey") + SUPPLIER_BASE).alias("head"), F.lit(1).alias("rel"),
                                         F.col("s_nationkey").cast("bigint").alias("tail")))
            .unionByName(nation.select(F.col("n_nationkey").cast("bigint").alias("head"), F.lit(2).alias("rel"),
                                       (F.col("n_regionkey") + REGION_BASE).cast("bigint").alias("tail"))))


def patterns(lineitem: DataFrame, n: int = 256) -> DataFrame:
    """Sparse patterns: one per order, members = distinct part ids mod n."""
    return (lineitem.select(F.col("l_orderkey").alias("pattern_id"),
                            F.pmod(F.col("l_partkey"), F.lit(n)).cast("int").alias("neuron"))
            .distinct())
