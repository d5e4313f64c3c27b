"""Relational operations the models, charts and reports are built from."""
