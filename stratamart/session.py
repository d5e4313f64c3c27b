"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE picks partition counts, splits skewed join partitions and turns a join into a
# broadcast only when the measured size is below the threshold; no plan here carries a
# broadcast hint, so a dimension that outgrows the threshold falls back to a shuffle join.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even if a later step then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
}


def get_session(master: str | None = None, app: str = "stratamart", **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()

# Arrow batches have as many rows as Spark's setting says but no more bytes than this, so memory does
# not grow with the length of texts; a size that the session names itself stays
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = 4 << 20
# a task that writes or reads a stored table holds a row group of it in memory
ROW_GROUP_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, whose Python may not find it by itself, and
    bound the batches that go there."""
    context = spark.sparkContext
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(BATCH_LIMIT))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="stratamart-")) / "stratamart.zip"  # read by the driver alone
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset the warehouse folder is used, which the session's tables share too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/stratamart/{label}-{uuid.uuid4().hex}"


# Spark's setting for it; else shuffle files stay until the driver happens to collect its garbage
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, every query deletes its shuffle files as soon as it has ended."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything this package wrote under the shared folder, when its results are done with."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/stratamart")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there afterwards.

    Used where later steps must see the very same rows (row positions, split points) even
    if an executor is lost and its tasks run again. Being parquet, later steps read only the
    columns they need.
    """
    path = scratch_path(df.sparkSession, "stable")
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
