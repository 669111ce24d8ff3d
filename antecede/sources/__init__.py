"""Readers, writers and table projections."""
