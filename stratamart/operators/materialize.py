"""Storing model results as catalog views and tables: replace, append, upsert, patch.

A ``Warehouse`` keeps every table of one database under one location. Full loads write a
new folder and then define the table on it, so running readers of the old rows are not
disturbed and a failed write leaves the table as it was. Keyed loads rewrite only the
partitions they touch. Superseded folders are left for an expiry rule on the location.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.operators.layout import by_columns
from stratamart.operators.quality import duplicates
from stratamart.operators.windows import latest_per_key
from stratamart.session import stable


def merge_rows(existing: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows, with those whose key occurs in ``delta`` replaced by it."""
    return existing.join(delta.select(*key).distinct(), list(key), "left_anti").unionByName(delta)


def insert_missing(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows plus the new ones whose key does not exist yet."""
    return existing.unionByName(new.join(existing.select(*key), list(key), "left_anti"))


def patch_rows(base: DataFrame, patch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Set the patch's columns for matching keys; a NULL in the patch keeps the old value."""
    changed = [c for c in patch.columns if c not in key]
    renamed = patch.select(*key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = base.join(renamed, list(key), "left")
    return joined.select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


# the hidden partition column of tables loaded by watermark, and its value without a time;
# an upsert rewrites whole periods and wants short ones, an append only reads the last one
PERIOD, NO_PERIOD = "_period", "none"
UPSERTED, APPENDED = "yyyy-MM", "yyyy"
# the tables of a run take about 0.7 of what they do by Spark's own default
CODEC = "zstd"
# the hidden partition column of tables that take numbered batches
BATCH = "_batch"
# where the keys of a table are: rows (key, partition columns) in hash buckets of about so many keys
BUCKET, BUCKET_KEYS = "_bucket", 1_000_000


def with_period(df: DataFrame, time: str, length: str) -> DataFrame:
    return df.withColumn(PERIOD, F.coalesce(F.date_format(time, length), F.lit(NO_PERIOD)))


class Warehouse:
    def __init__(self, spark: SparkSession, database: str, location: str, bucket_keys: int = BUCKET_KEYS) -> None:
        self.spark = spark
        self.bucket_keys = bucket_keys
        self.database = database
        self.location = location.rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.location}'")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def _stored(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def read(self, table: str) -> DataFrame:
        """The table's rows, without the columns that only lay them out."""
        return self._stored(table).drop(PERIOD, BATCH)

    def folder(self, table: str) -> str:
        """The name of the folder that holds a table's rows; a full load takes a new one."""
        found = self.spark.sql(f"DESCRIBE EXTENDED {self.name(table)}").where("col_name = 'Location'").first()
        return found["data_type"].rstrip("/").rsplit("/", 1)[1]

    def view(self, name: str, df: DataFrame) -> DataFrame:
        """A session view: nothing is stored, the plan is inlined wherever the view is used."""
        df.createOrReplaceTempView(name)
        return self.spark.table(name)

    def view_from_query(self, name: str, query: str) -> DataFrame:
        return self.view(name, self.spark.sql(query))

    def write(self, table: str, df: DataFrame, if_exists: str = "fail", partition_by: Sequence[str] = (),
              sort_by: Sequence[str] = (), unique: Sequence[str] = (), even_files: bool = True,
              bucket_by: Sequence[str] = (), buckets: int = 0, interleave: Sequence[str] = (), files: int = 0) -> DataFrame:
        """Store a DataFrame; ``if_exists`` is fail, replace or append.

        ``partition_by`` lays rows out by low-cardinality columns for partition pruning and
        ``sort_by`` orders rows within files so that row groups can be skipped; together they
        stand in for indexes. ``unique`` columns are verified before the table shows the rows: on
        the written files, or, where rows are appended, among them and by the key index of the
        table, of which only the buckets of their keys are read. ``even_files`` spends a shuffle on gathering each partition's
        rows into files of even size; without it every task writes a file per partition it has.
        ``bucket_by`` deals rows to ``buckets`` files (of a partition) by a hash of those columns, so
        tables bucketed alike are joined on them without a shuffle. ``interleave`` lays a full load
        out in ``files`` by several columns at once (``layout.by_columns``), so that a filter on any of
        them skips files.
        """
        if bool(bucket_by) != (buckets > 0) or bool(interleave) != (files > 0):
            raise ValueError("bucket_by needs buckets, and interleave needs files")
        if if_exists not in ("fail", "replace", "append"):
            raise ValueError(f"if_exists: {if_exists!r}")
        present = self.exists(table)
        if present and if_exists == "fail":
            raise ValueError(f"table {table} exists")
        # rebalancing splits the rows of a large partition over several tasks
        even = bool(partition_by) and even_files
        appended = present and if_exists == "append"
        if appended:
            target = self._stored(table)
            df, indexes = self._as_stored(df, target), self._indexes(table)
            if unique or indexes:
                df = stable(df)
            if unique:
                self._refuse_known(table, df, list(unique))
                indexes = self._indexes(table)
            for key in indexes:
                self._add_keys(table, key, df.select(*key, *self._parts(table)))
        laid_out = df.hint("rebalance", *[F.col(c) for c in partition_by]) if even else df
        if bucket_by and not appended:  # a bucket is written by one task
            laid_out = df.repartition(buckets, *bucket_by)
        elif interleave and not appended:
            laid_out = by_columns(df, interleave, files)
        if sort_by and not interleave:
            laid_out = laid_out.sortWithinPartitions(*partition_by, *sort_by)
        if appended:
            laid_out.select(*target.columns).write.mode("append").insertInto(self.name(table))
            return self.read(table)
        path = f"{self.location}/{table}/{uuid.uuid4().hex}"
        writer = laid_out.write.mode("errorifexists").option("compression", CODEC)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        shown = ""
        if bucket_by:  # the catalog has to know the buckets: written under a name of its own, then renamed
            shown = f"{table}__{uuid.uuid4().hex}"
            writer = writer.bucketBy(buckets, *bucket_by)
            writer = writer.sortBy(*sort_by) if sort_by else writer
            writer.option("path", path).option("partitionOverwriteMode", "dynamic").saveAsTable(self.name(shown))
        else:
            writer.parquet(path)
        if unique and not duplicates(self.spark.read.schema(df.schema).parquet(path), list(unique)).isEmpty():
            if shown:
                self.spark.sql(f"DROP TABLE {self.name(shown)}")
            raise ValueError(f"{table}: {', '.join(unique)} is not unique")
        for key in self._indexes(table):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(self._index_name(table, key))}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")  # external: the old folder stays for its readers
        if shown:
            self.spark.sql(f"ALTER TABLE {self.name(shown)} RENAME TO {self.name(table)}")
            return self.read(table)
        # with this option an overwrite replaces only the partitions it has rows for
        options, partitioned = f"compression '{CODEC}'", ""
        if partition_by:
            options += ", partitionOverwriteMode 'dynamic'"
            partitioned = f"PARTITIONED BY ({', '.join(partition_by)})"
        # partition columns come last in the stored table
        fields = [f for f in df.schema.fields if f.name not in partition_by]
        fields += [f for p in partition_by for f in df.schema.fields if f.name == p]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        self.spark.sql(f"CREATE TABLE {self.name(table)} ({ddl}) USING parquet OPTIONS ({options}) {partitioned} LOCATION '{path}'")
        if partition_by:
            self.spark.sql(f"MSCK REPAIR TABLE {self.name(table)}")
        return self.read(table)

    # -- key index: built when first asked for, kept by later loads, dropped with the table's rows -----

    @staticmethod
    def _as_stored(df: DataFrame, target: DataFrame) -> DataFrame:
        """The columns and types of a stored table: keys of another type would hash to another bucket."""
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema])

    @staticmethod
    def _index_name(table: str, key: Sequence[str]) -> str:
        return f"{table}__by__{'__'.join(key)}"

    def _indexes(self, table: str) -> list[list[str]]:
        """The keys by which a table has an index."""
        start = f"{table}__by__"
        found = self.spark.sql(f"SHOW TABLES IN {self.database}").where(F.col("tableName").startswith(start)).collect()
        return [r["tableName"][len(start):].split("__") for r in found]

    def _parts(self, table: str) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(self.name(table)) if c.isPartition]

    def _bucketed(self, keys: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
        return keys.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))

    def _index_size(self, name: str) -> tuple[int, int]:
        """Its buckets and about how many keys it has."""
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name(name)}").collect()}
        return int(found["index.buckets"]), int(found["index.keys"])

    def _build_index(self, table: str, key: Sequence[str]) -> None:
        name = self._index_name(table, key)
        keys = self._stored(table).select(*dict.fromkeys([*key, *self._parts(table)]))
        count = keys.count()
        buckets = max(1, -(-count // self.bucket_keys))
        self.write(name, self._bucketed(keys, key, buckets), "replace", [BUCKET])
        self.spark.sql(f"ALTER TABLE {self.name(name)} SET TBLPROPERTIES ('index.buckets' = '{buckets}', 'index.keys' = '{count}')")

    def _index(self, table: str, key: Sequence[str]) -> tuple[DataFrame, int]:
        """The index rows of a table and the number of its buckets."""
        name = self._index_name(table, key)
        if not self.exists(name):
            self._build_index(table, key)
        buckets, count = self._index_size(name)
        if count > 4 * buckets * self.bucket_keys:  # outgrown
            self._build_index(table, key)
            buckets, _ = self._index_size(name)
        return self._stored(name), buckets

    def _known(self, table: str, keys: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, list[int]]:
        """Index rows of the given keys, all index rows of their buckets, and these buckets. Only they are read."""
        index, buckets = self._index(table, key)
        touched = [r[0] for r in self._bucketed(keys.select(*key), key, buckets).select(BUCKET).distinct().collect()]
        near = index.where(F.col(BUCKET).isin(touched)) if touched else index.where(F.lit(False))
        return near.join(keys.select(*key).distinct(), list(key), "left_semi"), near, touched

    def _add_keys(self, table: str, key: Sequence[str], rows: DataFrame) -> None:
        """Note where rows are about to be stored. Until they are, the index has more than the table;
        never less, so a load that is lost half-way hides no row from the next one."""
        if not (new := rows.count()):
            return
        name = self._index_name(table, key)
        index, buckets = self._index(table, key)
        added = self._bucketed(rows.select(*dict.fromkeys([*key, *self._parts(table)])), key, buckets)
        added.select(*index.columns).write.mode("append").insertInto(self.name(name))
        _, count = self._index_size(name)
        self.spark.sql(f"ALTER TABLE {self.name(name)} SET TBLPROPERTIES ('index.keys' = '{count + new}')")

    def _refuse_known(self, table: str, rows: DataFrame, key: list[str]) -> None:
        repeated = not duplicates(rows, key).isEmpty()
        if not repeated:
            known = self._known(table, rows, key)[0]
            parts = self._parts(table)
            # the index may have keys of a load that was lost: a hit counts if the table has the row
            stored = self._stored(table)
            places = set(known.select(*parts).distinct().collect()) if parts else set()
            if parts and places:
                stored = stored.where(_any_partition(places, parts))
            repeated = not known.isEmpty() and not stored.join(known.select(*key).distinct(), key, "left_semi").isEmpty()
        if repeated:
            raise ValueError(f"{table}: {', '.join(key)} is not unique")

    def upsert(self, table: str, delta: DataFrame, key: Sequence[str], partition_by: Sequence[str] = (),
               period_of: str | None = None, newest_by: Sequence[str] = (), period_moves: bool = True) -> DataFrame:
        """Insert or replace rows by key. Repeating the same delta changes nothing.

        Of several rows of one key in the delta the newest is stored, by ``newest_by`` or else by
        the time column; without either a repeated key is an error. A key whose partition never
        changes (``period_moves`` false) needs no search for where it was stored before.

        With the table's partition columns given, or the time column whose ``period_of``
        partitions it by month, only partitions that receive a row or hold an old version of
        one are rewritten; otherwise the table is written anew. Where old versions are is looked up
        in the table's key index, of which a load reads and writes the buckets of its own keys.
        """
        newest = list(newest_by) or ([period_of] if period_of else [])
        key = list(key)
        if newest:
            delta = latest_per_key(delta, key, newest)
        elif not duplicates(delta, key).isEmpty():
            raise ValueError(f"{table}: {', '.join(key)} repeats in the rows to store; name newest_by")
        if period_of:
            delta, partition_by = with_period(delta, period_of, UPSERTED), [PERIOD]
        if not self.exists(table):
            return self.write(table, delta, partition_by=partition_by)
        existing = self._stored(table)
        delta = stable(self._as_stored(delta, existing))
        if not partition_by:
            return self.write(table, merge_rows(existing, delta, key), "replace")
        parts = list(partition_by)
        new_rows = delta.select(*dict.fromkeys([*key, *parts]))
        receiving = new_rows.select(*parts)
        emptied, moved = [], False
        if period_moves:
            known, _, buckets = self._known(table, delta, key)
            known = stable(known.select(*new_rows.columns))
            place = new_rows.columns
            moved = not known.join(new_rows, place, "left_anti").isEmpty()
            self._add_keys(table, key, stable(new_rows.join(known, place, "left_anti")))
            receiving = receiving.unionByName(known.select(*parts))
        touched = set(receiving.distinct().collect())
        if not touched:
            return self.read(table)
        in_touched = _any_partition(touched, parts)
        if moved:  # a partition may lose all its rows
            old_rows = existing.where(in_touched).select(*new_rows.columns)
            left = merge_rows(old_rows, new_rows, key).select(*parts, F.lit(True).alias("_left"))
            held = old_rows.select(*parts, F.lit(False).alias("_left")).unionByName(left)
            emptied = [r for r in held.groupBy(*parts).agg(F.max("_left").alias("_left")).collect() if not r["_left"]]
        merged = merge_rows(existing.where(in_touched), delta, key).select(*existing.columns)
        merged.write.mode("overwrite").insertInto(self.name(table))
        for row in emptied:  # nothing was written there, so its old rows would stay
            spec = ", ".join(f"{p} = {_literal(row[p])}" for p in parts)
            empty = f"{self.location}/{table}/{uuid.uuid4().hex}"
            self.spark.sql(f"ALTER TABLE {self.name(table)} PARTITION ({spec}) SET LOCATION '{empty}'")
        self.spark.catalog.refreshTable(self.name(table))
        if moved:  # the moved keys' old places go
            name = self._index_name(table, key)
            near = self._stored(name).where(F.col(BUCKET).isin(buckets))
            exact = merge_rows(near, self._bucketed(new_rows, key, self._index_size(name)[0]), key)
            stable(exact.select(*near.columns)).write.mode("overwrite").insertInto(self.name(name))
            self.spark.catalog.refreshTable(self.name(name))
        return self.read(table)

    def put_batch(self, table: str, rows: DataFrame, batch: str) -> None:
        """Store the rows of a numbered batch; putting it again replaces what it stored before."""
        rows = rows.withColumn(BATCH, F.lit(batch))
        if not self.exists(table):
            self.write(table, rows, partition_by=[BATCH], even_files=False)
            return
        self._as_stored(rows, self._stored(table)).write.mode("overwrite").insertInto(self.name(table))
        self.spark.catalog.refreshTable(self.name(table))

    def put_new(self, table: str, rows: DataFrame, key: Sequence[str], batch: str) -> None:
        """``put_batch`` of the rows whose key no other batch has stored, by the table's key index."""
        key = list(key)
        if self.exists(table):
            rows = self._as_stored(rows.withColumn(BATCH, F.lit(batch)), self._stored(table))
            known = self._known(table, rows, key)[0].where(F.col(BATCH) != batch)
            rows = stable(rows.join(known.select(*key).distinct(), key, "left_anti").select(*rows.columns))
        self.put_batch(table, rows.drop(BATCH), batch)
        if self.exists(self._index_name(table, key)):
            self._add_keys(table, key, rows.withColumn(BATCH, F.lit(batch)))

    def watermark(self, table: str, column: str) -> Any:
        """The greatest stored value, as a literal: unlike a subquery it reaches the scan's filters.

        A table laid out by period is asked for its last one only.
        """
        rows = self._stored(table)
        if PERIOD in rows.columns:  # the catalog knows the periods
            listed = [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()]
            dated = sorted(p for p in listed if p != NO_PERIOD)
            if not dated:
                return None
            for period in reversed(dated):  # an upsert may have emptied the last ones
                found = rows.where(F.col(PERIOD) == period).agg(F.max(column)).first()[0]
                if found is not None:
                    return found
            return None
        return rows.agg(F.max(column)).first()[0]

    def incremental(self, table: str, build: DataFrame, watermark: str, unique_key: str | None = None,
                    lookback: timedelta | None = None, row_key: Sequence[str] = ()) -> DataFrame:
        """Load a model's rows newer than the stored watermark; the first load takes all.

        Rows are upserted by ``unique_key``, or appended. Strictly newer rows miss ties and late
        arrivals: ``lookback`` re-reads that much before the watermark, and rows without a time
        are always read again. Appending needs a ``row_key`` for that, to leave out what is
        stored; without one only strictly newer rows are appended. The table is partitioned by the watermark's month, or by its
        year if rows are only appended, so a load touches the last periods only.
        """
        if lookback and not unique_key and not row_key:
            raise ValueError("lookback needs a unique_key or a row_key, else rows would be stored twice")
        length = UPSERTED if unique_key else APPENDED
        if not self.exists(table):
            return self.write(table, with_period(build, watermark, length), partition_by=[PERIOD],
                              even_files=bool(unique_key))
        newest = self.watermark(table, watermark)
        time, undated = F.col(watermark), F.col(watermark).isNull()
        since = None if newest is None else newest - (lookback or timedelta(0))
        if unique_key or row_key:
            delta = build if since is None else build.where((time >= F.lit(since) if lookback or row_key else time > F.lit(since)) | undated)
        elif newest is None:  # nothing stored, or only rows without a time, which must not be stored twice
            delta = build if self._stored(table).isEmpty() else build.where(~undated)
        else:
            delta = build.where(time > F.lit(newest))
        if unique_key:
            return self.upsert(table, delta, [unique_key], period_of=watermark)
        if row_key:
            stored = self.read(table)
            stored = stored if since is None else stored.where((time >= F.lit(since)) | undated)
            delta = delta.join(stored.select(*row_key), list(row_key), "left_anti").select(*build.columns)
        return self.write(table, with_period(delta, watermark, length), "append", [PERIOD], even_files=False)

    def python_model(self, table: str, fn: Callable[..., DataFrame], *inputs: DataFrame) -> DataFrame:
        """Store what a Python function makes of its inputs."""
        return self.write(table, fn(*inputs), "replace")


def _literal(value: Any) -> str:
    return f"'{value}'" if not isinstance(value, (int, float)) else str(value)


def _any_partition(rows: Sequence[Mapping[str, Any]], parts: Sequence[str]) -> Column:
    """Condition on partition columns only, so the scan prunes all other partitions."""
    if len(parts) == 1:
        return F.col(parts[0]).isin([r[parts[0]] for r in rows])
    return F.struct(*parts).isin([F.struct(*[F.lit(r[p]) for p in parts]) for r in rows])
