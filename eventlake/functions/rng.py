"""Reproducible uniforms keyed by data, never by call order.

u = first 32 bits of md5(seed:key) / 2^32.  The same number is computed by
DuckDB as ``cast('0x' || substr(md5(..), 1, 8) as bigint) / 4294967296.0``,
so random encoders and splits can be checked against an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        parts.append(k if isinstance(k, Column) else F.col(k))
    s = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def sql_hash_uniform(seed: int | str, *key_sql: str) -> str:
    """DuckDB twin of :func:`hash_uniform` (for oracle SQL)."""
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(CAST('0x' || substr(md5({inner}), 1, 8) AS BIGINT) / 4294967296.0)"
