"""Versioned, ordered, TTL-aware key-value tables as Spark DataFrames."""
