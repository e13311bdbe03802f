"""Structured Streaming ingest and upkeep of the churn features."""
