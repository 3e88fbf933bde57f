"""Streaming entry point.  The reference has no streaming operators; the
only stream here is the arrival of landed runs (``landed_runs``)."""
