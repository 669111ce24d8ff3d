"""Incremental batch operators, usable from ``foreachBatch``."""
