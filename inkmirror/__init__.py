"""Incremental document synchronisation as Spark jobs."""
