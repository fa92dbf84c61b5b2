"""Relational, statistical and learning operators on event tables."""
