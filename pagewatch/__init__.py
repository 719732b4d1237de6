"""Audit of web-page snapshots and detection of changes between them, as Spark jobs."""
