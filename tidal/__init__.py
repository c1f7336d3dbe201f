"""Keyed-series analytics operators on PySpark."""
