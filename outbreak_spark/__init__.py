"""Epidemic-surveillance analytics on Spark."""
