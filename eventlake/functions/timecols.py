"""Integer time steps from timestamps (TIMESTAMP_NTZ, no session-zone dependence)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the epoch of the driver's event table.
EVENT_EPOCH = "2024-01-01 00:00:00"


def _col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ntz_literal(value: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal that never passes through the session zone
    (a Python datetime literal would be read as a zoned TIMESTAMP first)."""
    text = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else str(value)
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def micros_since(ts: Column | str, epoch: str = EVENT_EPOCH) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz_literal(epoch), _col(ts).cast("timestamp_ntz"))


def millis_since(ts: Column | str, epoch: str = EVENT_EPOCH) -> Column:
    """floor(microseconds / 1000) as BIGINT — the `t` step of the event model."""
    return F.floor(micros_since(ts, epoch) / F.lit(1000)).cast("bigint")


def ts_at_millis(ms: int, epoch: str = EVENT_EPOCH) -> _dt.datetime:
    """First timestamp whose step is `ms` — pushes t-ranges down to the ts column."""
    return _dt.datetime.fromisoformat(epoch) + _dt.timedelta(milliseconds=ms)


# DuckDB twin used by oracle SQL.
SQL_T_MS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000)"
