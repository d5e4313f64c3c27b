"""Run the models: store each result as its configuration says and record the run."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.operators.history import records_from_log, write_runs
from stratamart.operators.materialize import Warehouse
from stratamart.plans.context import MODELS, MartContext
from stratamart.session import freed_shuffles

LOG = "run_id string, model string, execution_time double, timestamp string, status string, error string"
LAYERS = ("bronze", "silver", "gold")
# where a staged view reads more bytes of files than this, models are stored one at a time
AT_ONCE_BYTES = 64 << 20


class StoredContext(MartContext):
    """A context whose ``ref`` stores a model before giving its rows.

    Asking for one model therefore stores all it depends on, each once.
    """

    def __init__(self, source, as_of: date, warehouse: Warehouse) -> None:
        super().__init__(source, as_of)
        self.warehouse = warehouse
        self.run_id = f"run_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
        self.log: list[tuple] = []

    def ref(self, name: str) -> DataFrame:
        if name not in self._bound:
            if name not in MODELS:
                raise KeyError(f"no model named {name!r}")
            model = MODELS[name]
            start, status, error = time.perf_counter(), "success", None
            try:
                rows = model.build(self)
                start = time.perf_counter()
                self.bind(name, self._store(name, rows))
            except Exception as failure:
                status, error = "failed", str(failure)
                raise
            finally:
                now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
                self.log.append((self.run_id, name, time.perf_counter() - start, now, status, error))
        return self._bound[name]

    def _store(self, name: str, rows: DataFrame) -> DataFrame:
        model = MODELS[name]
        if model.materialized == "view":
            return self.warehouse.view(name, rows)
        if model.materialized == "incremental":
            return self.warehouse.incremental(name, rows, model.watermark, model.unique_key)
        if model.materialized == "table":
            return self.warehouse.write(name, rows, "replace", partition_by=model.layout)
        return rows


def read_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that a plan reads, by Spark's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def one_by_one() -> list[str]:
    """The models in the order in which least is on disk: those that shuffle most come first, while little
    is stored, and each after what it reads."""
    ordered = sorted(MODELS.values(), key=lambda m: (m.layer != "bronze", -m.priority, LAYERS.index(m.layer)))
    return [m.name for m in ordered]


def build_models(source, as_of: date, warehouse: Warehouse, names: Sequence[str] | None = None,
                 runs_path: str | None = None, parallel: int = 8) -> DataFrame:
    """Store the named models and what they depend on, by default all. Returns the run record.

    Models of one layer are independent of each other. Small ones are submitted together, so one model's
    small last stage does not leave the cluster idle. Large ones are stored one at a time, since the
    shuffles of all that run are on disk together; a model's go as soon as it is stored. The first
    failure ends the run; it is recorded like the rest.
    """
    ctx = StoredContext(source, as_of, warehouse)
    spark = warehouse.spark
    try:
        with freed_shuffles(spark), ThreadPoolExecutor(parallel) as pool:
            if names is None:
                staged = list(pool.map(ctx.ref, [m.name for m in MODELS.values() if m.layer == LAYERS[0]]))
                if max(map(read_bytes, staged)) > AT_ONCE_BYTES:
                    names = one_by_one()
            if names is not None:
                for name in names:
                    ctx.ref(name)
            else:
                for layer in LAYERS[1:]:
                    list(pool.map(ctx.ref, [m.name for m in MODELS.values() if m.layer == layer]))
    finally:
        log = spark.createDataFrame(ctx.log, LOG)
        record = records_from_log(log.withColumn("execution_time", F.round("execution_time", 6)))
        if runs_path:
            write_runs(record, runs_path)
    return record
