from types import SimpleNamespace
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq

from stratamart.session import BATCH_BYTES, BATCH_LIMIT, ROW_GROUP_BYTES, scratch_path, shared_dir, ship_package, stable


def fake(configured=None, warehouse="file:/warehouse/"):
    conf = {"spark.checkpoint.dir": configured, "spark.sql.warehouse.dir": warehouse}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf[key] or default))


def test_shared_folder_is_the_configured_one():
    assert shared_dir(fake("hdfs:///shared")) == "hdfs:///shared"
    assert scratch_path(fake("hdfs:///shared/"), "x").startswith("hdfs:///shared/stratamart/x-")


def test_without_one_the_warehouse_is_used():
    assert shared_dir(fake()) == "file:/warehouse/_shared"


def test_stable_rows_do_not_depend_on_their_source_any_more(spark):
    df = spark.range(100).selectExpr("id", "rand() AS r")
    kept = stable(df)
    assert kept.collect() == kept.collect() and kept.dtypes == df.dtypes


def batch_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    long = spark.range(0, 64, 1, 1).selectExpr("repeat(char(65 + id % 26), 500000) AS text")
    return long.mapInArrow(run, "n bigint, size bigint").collect()


def test_batches_of_long_texts_are_bounded(spark):
    ship_package(spark)
    found = batch_bytes(spark)
    assert sum(r.n for r in found) == 64 and max(r.size for r in found) <= BATCH_LIMIT + (1 << 20)


def test_a_batch_size_that_the_session_names_stays(spark):
    other = spark.newSession()
    other.conf.set(BATCH_BYTES, "123456789")
    ship_package(other)
    assert other.conf.get(BATCH_BYTES) == "123456789"


def test_a_stored_table_has_small_row_groups(spark):
    kept = stable(spark.range(0, 800, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 2000), k -> hex(xxhash64(id, k))), '') AS text"))
    assert kept.count() == 800
    groups = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in kept.inputFiles()]
    sizes = [m.row_group(k).total_byte_size for m in groups for k in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) <= 2 * ROW_GROUP_BYTES
