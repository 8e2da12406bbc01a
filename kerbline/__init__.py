"""Crash-aware route safety as PySpark DataFrame operators."""
