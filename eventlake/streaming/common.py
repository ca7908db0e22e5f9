"""Shared helpers for streaming jobs: scratch/checkpoint locations."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from eventlake.session import ensure_checkpoint_dir


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory
    (``spark.checkpoint.dir``), never a machine-local temp folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/eventlake-{name}-{uuid.uuid4().hex[:12]}"
