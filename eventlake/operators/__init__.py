"""Operators: DataFrame -> DataFrame functions grouped by family."""
