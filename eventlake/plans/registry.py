"""A tiny registry: query key -> (Spark builder, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, note)
        return fn
    return deco
