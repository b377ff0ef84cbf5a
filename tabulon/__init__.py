"""Tabulon: statistics, data preparation and exploration as PySpark DataFrame operations."""

__version__ = "0.1.0"
