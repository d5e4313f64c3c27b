"""Layered analytics marts on PySpark: staged, joined and aggregated business data."""
