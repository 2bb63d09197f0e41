"""Batch analytics over network-monitor logs, expressed as PySpark DataFrame jobs."""
