"""Queries over the star-schema tables, each with the SQL that must give the same rows."""

from stratamart.checks.registry import CHECKS, Check  # noqa: F401
from stratamart.checks import marts, scalars, joins, measures, charts, loads, science  # noqa: F401, E402
