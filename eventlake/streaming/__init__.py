"""Structured Streaming jobs: landing, record-while-query, live Silver,
stream matching and keyed reactive state."""
