"""Readers, logical workers and sinks."""
