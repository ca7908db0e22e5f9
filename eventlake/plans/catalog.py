"""Import every query module so that the registry is filled."""

from eventlake.plans import q_ingest, q_models, q_patterns, q_quality, q_reactive, q_signals, q_store, q_streaming, q_lake  # noqa: F401
from eventlake.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
