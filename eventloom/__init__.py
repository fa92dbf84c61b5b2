"""Spark jobs for wide tables of measured events (one row per cell)."""
