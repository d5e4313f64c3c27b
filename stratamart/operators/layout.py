"""Where rows go in a table's files, so that reads can skip files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamart.operators.windows import _place

BITS = 16  # steps of a column: 2^16 between its least and greatest value


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """A number whose bits are those of all ``columns`` in turn, highest first.

    Each column is put in even steps between its least and greatest value, NULLs first. Rows that are
    near in this number are near in every column, so files of a run of it have narrow ranges in all.
    """
    if not 1 <= len(columns) * bits <= 62:
        raise ValueError("columns times bits have to fit 62 bits")
    places = []
    for c in columns:
        if (place := _place(df, c)) is None:
            raise ValueError(f"{c}: values of its type have no order of numbers")
        places.append(place)
    ends = df.agg(F.struct(*[f(p).alias(f"{n}{i}") for i, p in enumerate(places) for f, n in ((F.min, "low"), (F.max, "high"))])).scalar()
    out = F.lit(0).cast("long")
    for i, place in enumerate(places):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        share = F.when(high > low, F.nanvl((place - low) / (high - low), F.lit(1.0))).otherwise(0.0)
        step = F.coalesce(F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")
        for b in range(bits):
            bit = F.shiftright(step, b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(columns) + len(columns) - 1 - i))
    return out


def by_columns(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """``df`` in ``files`` partitions by ranges of the interleaved columns, in their order within each;
    the columns themselves settle equal numbers, so a value that most rows share spreads over files."""
    ordered = df.withColumn("_interleaved", interleaved(df, columns, bits))
    order = ["_interleaved", *columns]
    return ordered.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_interleaved")
