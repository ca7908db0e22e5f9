"""Shared pieces of the llm operators: table access, shared-folder tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.sources.tables import table
from eventlake.streaming.common import run_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once as Parquet under spark.checkpoint.dir and read it back.

    Cuts the lineage: a lost executor re-reads the shared files.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
