"""Bulk import of sparse binary recordings into Bronze.

``.spk``  : header (magic b"SPK1", n_channels u32, duration u32), then per
            channel (offset u64, count u32), then each channel's u32 times.
``.spkl`` : append log of fixed 8-byte records (channel u32, time u32); a
            torn tail is ignored, out-of-range channels are dropped (counted).

Files are read with the ``binaryFile`` source and decoded per file inside
``mapInPandas`` with numpy; parallelism is per file, so recordings should
be written as many bounded files.  Undecodable files go to a rejects output.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the container formats.
SPK_MAGIC = b"SPK1"
SPK_HEADER = struct.Struct("<4sII")
SPK_INDEX = struct.Struct("<QI")
SPKL_RECORD = 8

_OUT = "stream_id string, channel int, t long, status string, dropped long"


def _reject(path: str, status: str) -> pd.DataFrame:
    return pd.DataFrame({"stream_id": [path], "channel": [None], "t": [None], "status": [status], "dropped": [0]})


def _decode_spk(path: str, data: bytes) -> pd.DataFrame:
    """Events of one recording, or one reject row when a size does not fit the file."""
    if len(data) < SPK_HEADER.size:
        return _reject(path, "short_file")
    magic, n, _ = SPK_HEADER.unpack_from(data, 0)
    if magic != SPK_MAGIC:
        return _reject(path, "bad_magic")
    body = SPK_HEADER.size + n * SPK_INDEX.size
    if len(data) < body:
        return _reject(path, "short_index")
    index = np.frombuffer(data, dtype=np.dtype([("at", "<u8"), ("n", "<u4")]), count=n, offset=SPK_HEADER.size)
    at, count = index["at"].astype(object), index["n"].astype(object)
    if any(a < body or a + 4 * c > len(data) for a, c in zip(at, count, strict=True) if c):
        return _reject(path, "bad_index")
    parts = [np.frombuffer(data, dtype="<u4", count=c, offset=a) for a, c in zip(at, count, strict=True) if c]
    times = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    channels = np.repeat(np.arange(n, dtype=np.int32), index["n"].astype(np.int64))
    return pd.DataFrame({"stream_id": path, "channel": channels, "t": times.astype(np.int64), "status": "ok", "dropped": 0})


def _decode_spkl(path: str, data: bytes, n_channels: int) -> pd.DataFrame:
    whole = len(data) // SPKL_RECORD                  # torn tail ignored
    rec = np.frombuffer(data, dtype="<u4", count=whole * 2).reshape(-1, 2)
    keep = rec[:, 0] < n_channels
    ch, tt = rec[keep, 0].astype(np.int32), rec[keep, 1].astype(np.int64)
    order = np.lexsort((ch, tt))                      # replay restores (t, channel) order
    df = pd.DataFrame({"stream_id": path, "channel": ch[order], "t": tt[order], "status": "ok", "dropped": 0})
    dropped = int((~keep).sum())
    if dropped:
        df = pd.concat([df, pd.DataFrame({"stream_id": [path], "channel": [None], "t": [None],
                                          "status": ["dropped_channel"], "dropped": [dropped]})])
    return df


def _read(spark: SparkSession, path: str, decode) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"].tolist(), pdf["content"].tolist()):
                yield decode(p, bytes(content)).astype({"dropped": "int64"})

    return files.mapInPandas(run, _OUT)


def read_spk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from ``.spk`` recordings (stream_id = file path)."""
    raw = _read(spark, path, _decode_spk)
    return (raw.filter("status = 'ok'").select("stream_id", "channel", "t"),
            raw.filter("status <> 'ok'").select("stream_id", "status", "dropped"))


def read_spkl(spark: SparkSession, path: str, n_channels: int) -> tuple[DataFrame, DataFrame]:
    """(events, drop report) from ``.spkl`` append logs."""
    raw = _read(spark, path, lambda p, d: _decode_spkl(p, d, n_channels))
    return (raw.filter("status = 'ok'").select("stream_id", "channel", "t"),
            raw.filter("status <> 'ok'").select("stream_id", "status", "dropped"))
