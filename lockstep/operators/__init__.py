"""Iterative algorithms and aggregations."""
