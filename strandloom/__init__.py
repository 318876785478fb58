"""Spark-first engine for windowed assembly, evidence aggregation and truth matching."""
