"""Joins, windows and aggregates over the typed tables."""
