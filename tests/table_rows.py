"""What the tests of the main library share."""

from __future__ import annotations


def rows(df):
    """The rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
