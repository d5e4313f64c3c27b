from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stratamart.operators.materialize import Warehouse, insert_missing, merge_rows, patch_rows
from stratamart.operators.materialize import BUCKET
from stratamart.streaming.incremental import new_files, stream_append, stream_matched, stream_upsert


@pytest.fixture
def warehouse(spark, tmp_path, request):
    name = "".join(c if c.isalnum() else "_" for c in request.node.name)
    return Warehouse(spark, f"t_{name}", str(tmp_path / "tables"))


def table(spark, *data, kind="id int, part string, v int"):
    return spark.createDataFrame(list(data), kind)


def test_write_modes(spark, warehouse):
    one, two = table(spark, (1, "a", 1)), table(spark, (2, "b", 2))
    warehouse.write("t", one)
    with pytest.raises(ValueError, match="exists"):
        warehouse.write("t", one)
    warehouse.write("t", two, "append")
    assert rows(warehouse.read("t")) == [(1, "a", 1), (2, "b", 2)]
    warehouse.write("t", warehouse.read("t").where("id = 2"), "replace")  # may read what it replaces
    assert rows(warehouse.read("t")) == [(2, "b", 2)]
    with pytest.raises(ValueError):
        warehouse.write("t", one, "overwrite")


def test_unique_is_verified_before_writing(spark, warehouse):
    with pytest.raises(ValueError, match="not unique"):
        warehouse.write("t", table(spark, (1, "a", 1), (1, "b", 2)), unique=["id"])
    assert not warehouse.exists("t")


@pytest.mark.parametrize("parts", [(), ("part",)])
def test_upsert_replaces_moves_and_repeats(spark, warehouse, parts):
    start = table(spark, (1, "a", 1), (2, "a", 2), (3, "b", 3), (4, "c", 4))
    delta = table(spark, (2, "d", 20), (3, "a", 30), (5, "a", 50))
    want = [("1", "a", 1), ("2", "d", 20), ("3", "a", 30), ("4", "c", 4), ("5", "a", 50)]

    def stored():
        return rows(warehouse.read("t").select(F.col("id").cast("string"), "part", "v"))

    warehouse.upsert("t", start, ["id"], parts)
    warehouse.upsert("t", delta, ["id"], parts)
    assert stored() == want  # partition b lost its only row
    warehouse.upsert("t", delta, ["id"], parts)
    assert stored() == want
    warehouse.upsert("t", table(spark, (6, "b", 60)), ["id"], parts)
    assert stored() == sorted([*want, ("6", "b", 60)])
    warehouse.write("t", table(spark, (7, "b", 70)), "append")
    assert stored() == sorted([*want, ("6", "b", 60), ("7", "b", 70)])


def test_upsert_leaves_other_partitions_alone(spark, warehouse):
    warehouse.upsert("t", table(spark, (1, "a", 1), (2, "b", 2)), ["id"], ["part"])
    files = lambda: {r[0] for r in warehouse.read("t").where("part = 'b'").select(F.input_file_name()).collect()}
    before = files()
    warehouse.upsert("t", table(spark, (1, "a", 10)), ["id"], ["part"])
    assert files() == before


def test_incremental_takes_strictly_newer_rows(spark, warehouse):
    first = spark.sql("SELECT 1 AS id, DATE '2024-01-01' AS day UNION ALL SELECT 2, DATE '2024-01-05'")
    later = first.union(spark.sql("SELECT 3, DATE '2024-01-05' UNION ALL SELECT 4, DATE '2024-01-03' "
                                  "UNION ALL SELECT 5, DATE '2024-01-06'"))
    warehouse.incremental("t", first, "day")
    warehouse.incremental("t", later, "day")
    assert [r.id for r in warehouse.read("t").orderBy("id").collect()] == [1, 2, 5]  # a tie and a late row are missed


def test_rows_without_a_watermark_are_loaded_once(spark, warehouse):
    empty = spark.sql("SELECT 1 AS id, CAST(NULL AS DATE) AS day WHERE false")
    nulls = spark.sql("SELECT 1 AS id, CAST(NULL AS DATE) AS day")
    dated = nulls.union(spark.sql("SELECT 2, DATE '2024-01-01'"))
    for build in (empty, nulls, nulls, dated, dated):
        warehouse.incremental("t", build, "day")
    assert [r.id for r in warehouse.read("t").orderBy("id").collect()] == [1, 2]


def test_lookback_picks_up_ties_and_late_rows(spark, warehouse):
    first = spark.sql("SELECT 1 AS id, DATE '2024-01-01' AS day UNION ALL SELECT 2, DATE '2024-01-05'")
    later = first.union(spark.sql("SELECT 3, DATE '2024-01-05' UNION ALL SELECT 4, DATE '2024-01-03'"))
    with pytest.raises(ValueError, match="unique_key"):
        warehouse.incremental("t", first, "day", lookback=timedelta(days=3))
    warehouse.incremental("t", first, "day", "id")
    warehouse.incremental("t", later, "day", "id", timedelta(days=3))
    warehouse.incremental("t", later, "day", "id", timedelta(days=3))
    assert [r.id for r in warehouse.read("t").orderBy("id").collect()] == [1, 2, 3, 4]


def test_watermark_reaches_the_scan(spark, warehouse):
    warehouse.write("t", spark.sql("SELECT 1 AS id, DATE '2024-01-05' AS day"))
    newest = warehouse.watermark("t", "day")
    plan = warehouse.read("t").where(F.col("day") > F.lit(newest))._jdf.queryExecution().toString()
    assert "GreaterThan(day,2024-01-05)" in plan


def test_merge_insert_and_patch(spark):
    base = table(spark, (1, "a", 1), (2, "b", 2))
    assert rows(merge_rows(base, table(spark, (2, "z", 9), (3, "n", 3)), ["id"])) == [
        (1, "a", 1), (2, "z", 9), (3, "n", 3)]
    assert rows(insert_missing(base, table(spark, (2, "z", 9), (3, "n", 3)), ["id"])) == [
        (1, "a", 1), (2, "b", 2), (3, "n", 3)]
    patch = spark.createDataFrame([(1, None, 7), (9, "x", 9)], "id int, part string, v int")
    assert rows(patch_rows(base, patch, ["id"])) == [(1, "a", 7), (2, "b", 2)]


def test_streams_take_each_file_once(spark, warehouse, tmp_path):
    kind = "id int, part string, v int"
    arriving, target = str(tmp_path / "in"), str(tmp_path / "out")
    double = lambda df: df.withColumn("v", F.col("v") * 2)

    def run():
        stream_append(new_files(spark, arriving, kind), double, target, str(tmp_path / "c1"))
        stream_upsert(new_files(spark, arriving, kind), double, warehouse, "t", ["id"], str(tmp_path / "c2"))

    table(spark, (1, "a", 1), (2, "a", 2)).write.parquet(arriving)
    run()
    run()  # nothing new
    table(spark, (2, "a", 5)).write.mode("append").parquet(arriving)
    run()
    assert rows(spark.read.parquet(target)) == [(1, "a", 2), (2, "a", 10), (2, "a", 4)]
    assert rows(warehouse.read("t")) == [(1, "a", 2), (2, "a", 10)]


def test_upsert_of_nothing_keeps_the_columns(spark, warehouse):
    rows_of = "id int, ts timestamp, v int"
    first = spark.sql("SELECT 1 AS id, TIMESTAMP'2020-01-05' AS ts, 1 AS v")
    warehouse.incremental("t", first, "ts", "id")
    again = warehouse.incremental("t", spark.createDataFrame([], rows_of), "ts", "id")
    assert again.columns == ["id", "ts", "v"] and again.count() == 1


def test_a_key_is_stored_once(spark, warehouse):
    warehouse.upsert("t", table(spark, (1, "a", 1)), ["id"], ["part"])
    twice = table(spark, (2, "a", 1), (2, "b", 5), (1, "b", 3))
    with pytest.raises(ValueError, match="newest_by"):
        warehouse.upsert("t", twice, ["id"], ["part"])
    warehouse.upsert("t", twice, ["id"], ["part"], newest_by=["v"])
    assert rows(warehouse.read("t").select("id", "part", "v")) == [(1, "b", 3), (2, "b", 5)]


def test_two_pending_files_with_one_key(spark, warehouse, tmp_path):
    kind = "id int, ts timestamp_ntz, v int"
    for n in (1, 2):
        spark.sql(f"SELECT 7 AS id, TIMESTAMP_NTZ'2020-01-0{n}' AS ts, {n} AS v").write.mode("append").parquet(str(tmp_path / "in"))
    stream_upsert(new_files(spark, str(tmp_path / "in"), kind), lambda d: d, warehouse, "t", ["id"], str(tmp_path / "state"), "ts")
    assert [r.v for r in warehouse.read("t").collect()] == [2]


def test_append_reads_late_and_undated_rows_by_row_key(spark, warehouse):
    load = lambda *data: warehouse.incremental(
        "t", spark.createDataFrame(list(data), "id int, day string").selectExpr("id", "CAST(day AS TIMESTAMP) AS ts"), "ts",
        row_key=["id"], lookback=timedelta(days=3))
    load((1, "2020-01-05"))
    load((1, "2020-01-05"), (2, "2020-01-05"), (3, None), (4, "2020-01-03"))
    load((3, None), (5, "2020-02-01"), (6, None))
    assert sorted(r.id for r in warehouse.read("t").collect()) == [1, 2, 3, 4, 5, 6]


def test_an_append_that_breaks_unique_is_refused(spark, warehouse):
    warehouse.write("t", table(spark, (1, "a", 1), (2, "b", 2)), unique=["id"])
    warehouse.write("t", table(spark, (3, "a", 3)), "append", unique=["id"])
    for bad in ([(3, "z", 9)], [(4, "a", 1), (4, "a", 1)], [(5, "a", 1), (1, "b", 1)]):
        with pytest.raises(ValueError, match="not unique"):
            warehouse.write("t", table(spark, *bad), "append", unique=["id"])
    warehouse.write("t", table(spark, (4, "a", 4)), "append")  # unchecked, but known to later checks
    with pytest.raises(ValueError, match="not unique"):
        warehouse.write("t", table(spark, (4, "c", 5), kind="id bigint, part string, v int"), "append", unique=["id"])
    # a load that was lost after its keys were noted does not stand in the way
    warehouse._add_keys("t", ["id"], table(spark, (9, "a", 9)))
    warehouse.write("t", table(spark, (9, "a", 9)), "append", unique=["id"])
    assert [r.id for r in warehouse.read("t").orderBy("id").collect()] == [1, 2, 3, 4, 9]
    warehouse.write("t", table(spark, (1, "a", 1)), "replace")
    warehouse.write("t", table(spark, (2, "a", 1)), "append", unique=["id"])  # the index went with the old rows


@pytest.fixture
def read_files(spark):
    """The files that jobs read, by the plans they run."""
    def of(df):
        return {f for f in df.inputFiles()}

    return of


def test_an_upsert_reads_and_writes_the_buckets_of_its_keys_only(spark, tmp_path, read_files):
    w = Warehouse(spark, "t_buckets", str(tmp_path / "tables"), bucket_keys=50)
    w.upsert("t", spark.range(2000).selectExpr("id", "CAST(id % 7 AS STRING) AS part", "1 AS v"), ["id"], ["part"])
    delta = spark.createDataFrame([(5, "0", 2), (2001, "1", 2)], "id bigint, part string, v int")
    w.upsert("t", delta, ["id"], ["part"])
    index, buckets = w._index("t", ["id"])
    assert buckets == 40 and index.count() == 2001
    known, near, touched = w._known("t", delta, ["id"])
    assert len(touched) == 2 and sorted(tuple(r) for r in known.select("id", "part").collect()) == [(5, "0"), (2001, "1")]
    assert len({f.split(f"{BUCKET}=")[1].split("/")[0] for f in read_files(near)}) == 2
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan or f"PartitionFilters: [{BUCKET}" in plan
    assert w.read("t").where("id = 5").count() == 1 and w.read("t").count() == 2001
    before = read_files(index)
    w.upsert("t", spark.createDataFrame([(5, "3", 3)], delta.schema), ["id"], ["part"])
    after = read_files(w._index("t", ["id"])[0])
    assert len({f.split(f"{BUCKET}=")[1].split("/")[0] for f in before ^ after}) == 1
    assert [tuple(r) for r in w.read("t").where("id = 5").select("part", "v").collect()] == [("3", 3)]


def test_an_outgrown_index_is_built_anew(spark, tmp_path):
    w = Warehouse(spark, "t_outgrown", str(tmp_path / "tables"), bucket_keys=10)
    rows_of = lambda a, b: spark.range(a, b).selectExpr("id", "CAST(id % 3 AS STRING) AS part", "id AS v")
    w.upsert("t", rows_of(0, 10), ["id"], ["part"])
    w.upsert("t", rows_of(5, 100), ["id"], ["part"])
    assert w._index_size("t__by__id")[0] == 1
    w.upsert("t", rows_of(90, 95), ["id"], ["part"])
    assert w._index_size("t__by__id")[0] == 10 and w.read("t").count() == 100


def test_a_load_lost_after_its_rows_were_stored(spark, warehouse, monkeypatch):
    """The index then has old and new places; a later load still finds every row."""
    warehouse.upsert("t", table(spark, (1, "a", 1), (2, "b", 2)), ["id"], ["part"])
    lost = table(spark, (1, "c", 10))
    warehouse._add_keys("t", ["id"], lost)  # noted, but its rows were not stored
    warehouse.upsert("t", table(spark, (1, "d", 20)), ["id"], ["part"])
    assert rows(warehouse.read("t").select("id", "part", "v")) == [(1, "d", 20), (2, "b", 2)]


def test_rows_wait_for_their_partner_and_are_stored_once(spark, warehouse, tmp_path):
    kind = "id int, at int, v string"
    arriving, state = str(tmp_path / "in"), str(tmp_path / "state")

    def run(partners, *data):
        if data:
            spark.createDataFrame(list(data), kind).write.mode("append").parquet(arriving)
        known = spark.createDataFrame([(p,) for p in partners], "id int")
        stream_matched(new_files(spark, arriving, kind), lambda df: df.join(known, "id"), ["id"], warehouse, "t", "waiting", state, ["at"])
        return rows(warehouse.read("t").select("id", "at", "v"))

    assert run([1], (1, 1, "a"), (2, 1, "old"), (3, 1, "x")) == [(1, 1, "a")]
    assert run([1], (2, 5, "new"), (1, 9, "late")) == [(1, 1, "a")]  # a stored key stays as it is
    assert run([1, 2]) == [(1, 1, "a"), (2, 5, "new")]  # the newer of two waiting rows
    assert run([1, 2], (2, 7, "again")) == [(1, 1, "a"), (2, 5, "new")]
    assert [r.id for r in warehouse.read("waiting").collect()] == [3]
    assert run([1, 2, 3]) == [(1, 1, "a"), (2, 5, "new"), (3, 1, "x")] and warehouse.read("waiting").count() == 0


def test_a_batch_that_runs_again_stores_nothing_twice(spark, warehouse):
    for _ in range(2):
        warehouse.put_new("t", table(spark, (1, "a", 1), (2, "a", 2)), ["id"], "b0")
    for _ in range(2):
        warehouse.put_new("t", table(spark, (2, "a", 9), (3, "a", 3)), ["id"], "b1")
    assert rows(warehouse.read("t").select("id", "v")) == [(1, 1), (2, 2), (3, 3)]


def test_tables_bucketed_alike_are_joined_without_a_shuffle(spark, warehouse):
    lines = spark.range(4000).selectExpr("id % 500 AS order_id", "id AS line")
    orders = spark.range(500).selectExpr("id AS order_id", "id * 2 AS customer")
    warehouse.write("lines", lines, bucket_by=["order_id"], buckets=4, sort_by=["order_id"])
    warehouse.write("orders", orders.where("order_id < 400"), bucket_by=["order_id"], buckets=4, sort_by=["order_id"], unique=["order_id"])
    warehouse.write("orders", orders.where("order_id >= 400"), "append", unique=["order_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = warehouse.read("lines").join(warehouse.read("orders"), "order_id")
        assert joined.count() == 4000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="not unique"):
        warehouse.write("orders", orders.union(orders), "replace", bucket_by=["order_id"], buckets=4, unique=["order_id"])
    assert warehouse.read("orders").count() == 500  # the old rows stayed
    with pytest.raises(ValueError, match="needs buckets"):
        warehouse.write("more", orders, bucket_by=["order_id"])


def test_interleaved_columns_let_filters_on_each_skip_files(spark, warehouse):
    df = spark.range(20_000).selectExpr("id", "CAST(pmod(xxhash64(id), 1000) AS INT) AS a", "DATE_ADD(DATE'2020-01-01', CAST(pmod(xxhash64(id, 1), 900) AS INT)) AS b",
                                        "IF(id % 7 = 0, NULL, CAST(id AS STRING)) AS c")
    warehouse.write("t", df, interleave=["a", "b"], files=16)
    stored = warehouse.read("t")
    assert stored.exceptAll(df).count() == 0 and stored.count() == 20_000
    spans = stored.groupBy(F.input_file_name()).agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).collect()
    read = {c: sum(r[i] <= v <= r[i + 1] for r in spans) for c, i, v in (("a", 1, 437), ("b", 3, df.select(F.lit("2021-04-04").cast("date")).first()[0]))}
    assert len(spans) == 16 and max(read.values()) <= 8  # sorted by one column, the other would need all 16
    warehouse.write("u", df, interleave=["c", "a"], files=4)
    assert warehouse.read("u").count() == 20_000
    with pytest.raises(ValueError, match="no order"):
        warehouse.write("v", df.selectExpr("struct(id) AS s"), interleave=["s"], files=2)


@pytest.mark.parametrize("parts", [(), ("part",)])
def test_tables_are_stored_compressed(spark, warehouse, tmp_path, parts):
    warehouse.write("t", table(spark, (1, "a", 1)), partition_by=parts)
    warehouse.write("t", table(spark, (2, "b", 2)), "append")
    written = [pq.ParquetFile(f).metadata for f in (tmp_path / "tables").rglob("*.parquet")]
    assert [m.row_group(0).column(0).compression for m in written if m.num_rows] == ["ZSTD", "ZSTD"]
