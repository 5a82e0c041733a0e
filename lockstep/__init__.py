"""Lockstep: iterative, bulk-synchronous analytics on PySpark."""
