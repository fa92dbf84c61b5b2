"""Structured Streaming jobs for arriving sample files."""
