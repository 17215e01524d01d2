"""Batch and streaming jobs for competitive-advertising intelligence on Spark."""
