"""The list of checks.

Both sides of a check are cast to one declared list of columns, so that engine-specific
result types (decimal scales, wide integers, timestamp units) do not count as differences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.checks.sql import with_views
from stratamart.plans import MartContext
from stratamart.sources import Tables, raw_source

# the day that stands for "today" in the order tables and in the event tables
ORDERS_AS_OF, EVENTS_AS_OF = date(2001, 8, 1), date(2024, 1, 20)

_DUCKDB = {"long": "BIGINT", "double": "DOUBLE", "text": "VARCHAR", "bool": "BOOLEAN"}
_SPARK = {"long": "bigint", "double": "double", "text": "string", "bool": "boolean"}


def columns(spec: str) -> list[tuple[str, str]]:
    """``"long: a b, text: c"`` as ``[(a, long), (b, long), (c, text)]``."""
    out = []
    for part in spec.split(","):
        kind, names = part.split(":")
        out += [(name, kind.strip()) for name in names.split()]
    return out


@dataclass(frozen=True)
class Check:
    name: str
    spec: str
    build: Callable[[Tables], DataFrame]
    query: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[F.col(f"`{c}`").cast(_SPARK[kind]).alias(c) for c, kind in columns(self.spec)])

    def oracle(self) -> str | None:
        if self.query is None:
            return None
        casts = ", ".join(f'CAST("{c}" AS {_DUCKDB[kind]}) AS "{c}"' for c, kind in columns(self.spec))
        return with_views(f"SELECT {casts} FROM (\n{self.query.strip()}\n) checked")


CHECKS: dict[str, Check] = {}


def check(name: str, spec: str, query: str | None):
    """Register a ``fn(tables) -> DataFrame`` as the query ``name``."""

    def register(fn):
        if name in CHECKS:
            raise ValueError(f"duplicate check {name}")
        CHECKS[name] = Check(name, spec, fn, query)
        return fn

    return register


def orders_mart(t: Tables) -> MartContext:
    return MartContext(raw_source(t), ORDERS_AS_OF)


def events_mart(t: Tables) -> MartContext:
    return MartContext(raw_source(t), EVENTS_AS_OF)
