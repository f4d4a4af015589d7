"""Structured Streaming modes: budget admission (T1) and the metrics feed."""
