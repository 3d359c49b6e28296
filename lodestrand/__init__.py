"""Part of the ingest and profiling engine."""
