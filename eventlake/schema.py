"""Schemas of the event model."""

from pyspark.sql import types as T

# M1: one spike/event. stream_id lets many recordings/devices share a table.
EVENTS = T.StructType([
    T.StructField("stream_id", T.StringType(), False),
    T.StructField("channel", T.IntegerType(), False),
    T.StructField("t", T.LongType(), False),
])

# M2 bounds: one row per stream.
STREAMS = T.StructType([
    T.StructField("stream_id", T.StringType(), False),
    T.StructField("n_channels", T.IntegerType(), False),
    T.StructField("duration", T.LongType(), False),
])

# M5 Silver.
SILVER = T.StructType([
    T.StructField("stream_id", T.StringType(), False),
    T.StructField("channel", T.IntegerType(), False),
    T.StructField("bin", T.LongType(), False),
    T.StructField("spikes", T.LongType(), False),
])

# M7 signal window.
SIGNALS = T.StructType([
    T.StructField("window_id", T.LongType(), False),
    T.StructField("label", T.StringType(), True),
    T.StructField("vec", T.ArrayType(T.DoubleType()), False),
])

# M10 unknown record.
UNKNOWNS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("dist", T.DoubleType(), True),
    T.StructField("vec", T.ArrayType(T.DoubleType()), False),
])

# M12 event-camera event.
CAMERA = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("t", T.LongType(), False),
    T.StructField("p", T.IntegerType(), False),
])

# M14 triple.
TRIPLES = T.StructType([
    T.StructField("head", T.LongType(), False),
    T.StructField("rel", T.IntegerType(), False),
    T.StructField("tail", T.LongType(), False),
])

JSON_EVENT = T.StructType([
    T.StructField("t", T.LongType(), True),
    T.StructField("channel", T.IntegerType(), True),
])
