"""Column-level helpers built from native Spark expressions (no Python UDFs)."""
