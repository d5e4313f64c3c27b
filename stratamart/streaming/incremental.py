"""Incremental models as streams over newly arrived files.

``availableNow`` takes every file not seen before, then stops: the stream's checkpoint plays
the part of the watermark, and late rows are loaded like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.operators.materialize import BATCH, Warehouse
from stratamart.operators.windows import latest_per_key
from stratamart.session import stable


def new_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files that appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_append(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str,
                  checkpoint: str) -> None:
    """Append the transformed new rows to parquet files, each exactly once."""
    query = (
        transform(stream).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_matched(stream: DataFrame, match: Callable[[DataFrame], DataFrame], key: Sequence[str], warehouse: Warehouse,
                   table: str, pending: str, checkpoint: str, newest_by: Sequence[str] = ()) -> None:
    """Store the rows of new files that ``match`` finds partners for, once per key; the others wait.

    A batch offers its own rows only; what waits, in the warehouse table ``pending``, is offered
    again once at the end of a run, so a row that comes before its partner is stored as soon as
    both are there. ``key`` names the columns that tell a row and its match; of several rows of one
    key in a batch or among the waiting the newest counts, by ``newest_by`` or else by all columns.

    Each batch is a partition of its tables, so one that runs again replaces what it wrote, and
    what earlier batches stored is known from the key index, of which it reads the buckets of its
    keys: its work does not grow with the table.
    """
    key = list(key)

    def settled(rows: DataFrame) -> DataFrame:
        newest = [*newest_by, *[c for c in rows.columns if c not in (*key, *newest_by)]]
        return latest_per_key(rows, key, newest) if newest else rows.dropDuplicates(key)

    def load(batch: DataFrame, name: str) -> DataFrame:
        """Store the matches of a batch; its other rows are returned."""
        offered = stable(settled(batch))
        matched = stable(match(offered))
        warehouse.put_new(table, matched, key, name)
        return offered.join(matched.select(*key), key, "left_anti").select(*offered.columns)

    def arrived(batch: DataFrame, number: int) -> None:
        warehouse.put_batch(pending, load(batch, f"b{number}"), f"b{number}")

    query = (
        stream.writeStream.foreachBatch(arrived)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if warehouse.exists(pending):
        # the folder of the waiting rows names the offer: lost half-way, it is the same one next time
        offer = warehouse.folder(pending)
        left = stable(load(warehouse.read(pending), f"o{offer}"))
        warehouse.write(pending, left.withColumn(BATCH, F.lit(f"w{offer}")), "replace", [BATCH], even_files=False)


def stream_upsert(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], warehouse: Warehouse, table: str,
                  key: Sequence[str], checkpoint: str, period_of: str | None = None,
                  newest_by: Sequence[str] = ()) -> None:
    """Upsert the transformed new rows into a warehouse table, laid out by the month of ``period_of``.

    A batch repeated after a failure replaces the rows it wrote before. Of several rows with
    one key in a batch the newest is kept, by ``newest_by`` (or else the time column); put the
    file's modification time there where files repeat a key.
    """

    def load(batch: DataFrame, _: int) -> None:
        warehouse.upsert(table, transform(batch), key, period_of=period_of, newest_by=newest_by)

    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
