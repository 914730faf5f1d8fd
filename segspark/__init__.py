"""Pooled-variant analytics on Spark."""
