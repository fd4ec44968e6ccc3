import os
import tempfile
import time

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from dataweft.session import cut, shared_dir, shuffles_go, work_path
from dataweft.sources import io, layout, versions


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_csv_inference_and_dates(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "2020-01-02"), (None, 2, None)], "s string, n int, d string")
    io.write_csv(df, str(tmp_path / "c"), compression="gzip")
    back = io.read_csv(spark, str(tmp_path / "c"), schema="s string, n int, d string", dates=["d"], view="csv_rows")
    assert dict(back.dtypes)["d"] == "date" and spark.table("csv_rows").count() == 2
    assert dict(io.read_csv(spark, str(tmp_path / "c")).dtypes)["n"] == "int"


def test_conform_by_name_with_casts(spark):
    schema = StructType([StructField("a", IntegerType()), StructField("b", StringType())])
    df = spark.createDataFrame([("x", "7")], "b string, a string")
    assert io.conform(df, schema).first().asDict() == {"a": 7, "b": "x"}
    with pytest.raises(ValueError, match="missing columns: b"):
        io.conform(df.drop("b"), schema)


def test_append_by_name_and_evolution(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(4, 3)], "y int, x int")
    assert rows(io.append(a, b), "x", "y") == [(1, 2), (3, 4)]
    assert rows(io.append(a, b.drop("y"), evolve=True), "x", "y") == [(1, 2), (3, None)]
    assert io.empty(spark, "x int").count() == 0


def test_partition_filter_prunes_directories(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 4).alias("k"), "id")
    stored = io.write_partitioned(df, str(tmp_path / "p"), ["k"])
    assert sorted(n for n in os.listdir(tmp_path / "p") if n.startswith("k=")) == ["k=0", "k=1", "k=2", "k=3"]
    text = stored.where("k = 2").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in text and stored.where("k = 2").count() == 25


def test_nested_and_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\nb\n")
    assert rows(io.read_lines(spark, str(tmp_path / "t.txt"))) == [("",), ("a",), ("b",)]
    (tmp_path / "j.json").write_text('{"messages": [{"role": "user", "content": "hi"}]}\n')
    nested = io.read_nested(spark, str(tmp_path / "j.json"), "json", "messages array<struct<role: string, content: string>>")
    assert nested.select("messages.content").first()[0] == ["hi"]


def test_versions(spark):
    path = work_path(spark, "v")
    df = spark.createDataFrame([(1, 10), (2, 30)], "id int, price int")
    assert versions.create(df, path) == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        versions.create(df, path)
    assert versions.commit(df.select((F.col("id") + 100).alias("id"), "price"), path, "insert", add=True) == 1
    assert versions.commit(df.where("id = 1"), path, "overwrite") == 2
    assert [versions.read_version(spark, path, v).count() for v in (0, 1, 2)] == [2, 4, 1]
    assert rows(versions.history(spark, path), "version", "operation", "n_rows") == [
        (0, "create", 2), (1, "insert", 2), (2, "overwrite", 1)]
    both = versions.compare(versions.read_version(spark, path, 1), versions.read_version(spark, path, 0), {"avg": F.avg("price"), "n": F.count("price")}, ("v1", "v0"))
    assert both.first().asDict() == {"avg_v1": 20.0, "avg_v0": 20.0, "n_v1": 4, "n_v0": 2, "avg_difference": 0.0, "n_difference": 2}
    assert "Cartesian" not in plan(both) and "NestedLoop" not in plan(both)
    with pytest.raises(ValueError):
        versions.read_version(spark, path, 9)


def test_change_feed_replays(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 5), (4, "d", None)], "k int, s string, n int")
    feed = versions.changes(old, new, ["k"]).persist()
    assert rows(feed, "k", "change_type") == [(2, "update_postimage"), (2, "update_preimage"), (3, "delete"), (4, "insert")]
    gone = feed.where("change_type IN ('delete', 'update_preimage')").select("k")
    came = feed.where("change_type IN ('insert', 'update_postimage')").drop("change_type")
    assert rows(old.join(gone, "k", "left_anti").unionByName(came)) == rows(new)


def test_states_are_read_by_partition(spark):
    path = work_path(spark, "v")
    df = spark.createDataFrame([(1, 10), (2, 30)], "id int, price int")
    versions.create(df, path)
    versions.commit(df, path, "insert", add=True)
    versions.commit(df, path, "overwrite")
    text = plan(versions.read_version(spark, path, 1))
    assert "PartitionFilters: [" in text and "version" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("/base=")[1].split("/")[0] for f in versions.read_version(spark, path, 1).inputFiles()} <= {"0", "2"}
    assert sorted(n for n in os.listdir(path) if "=" in n) == ["base=0", "base=2"]
    # A write that is tried again replaces its own partition only.
    versions._write(df.limit(1), path, 0, 1, "insert", "overwrite")
    assert [versions.read_version(spark, path, v).count() for v in (0, 1, 2)] == [2, 3, 2]


def test_changes_of_equal_rows(spark):
    old = [(1, "a")] * 3 + [(2, None)] * 2 + [(3, "c")]
    new = [(1, "a")] + [(2, None)] * 4 + [(None, "c")]
    a, b = (spark.createDataFrame(x, "k int, s string") for x in (old, new))
    feed = versions.row_changes(a, b.select("s", "k"))
    assert rows(feed) == [(None, "c", "insert"), (1, "a", "delete"), (1, "a", "delete"), (2, None, "insert"), (2, None, "insert"), (3, "c", "delete")]
    part = lambda kind: feed.where(F.col("change_type") == kind).drop("change_type")
    assert rows(a.exceptAll(part("delete")).unionByName(part("insert"))) == rows(b)
    assert versions.row_changes(a, a).count() == 0


def test_interleaved_files_are_skipped_on_both_columns(spark, tmp_path):
    import pyarrow.parquet as pq
    df = spark.range(8000).select((F.xxhash64("id", F.lit(1)) % 1000).alias("a"), F.format_string("k%03d", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(500))).alias("b"), "id")
    df = df.unionByName(spark.createDataFrame([(None, None, -1)], "a bigint, b string, id bigint"))
    stored = layout.write_interleaved(df, str(tmp_path / "z"), ["a", "b"], 16)
    assert rows(stored) == rows(df)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()]
    assert len(files) >= 12
    for column, value in ((0, 17), (1, "k123")):
        ranges = [(s.min, s.max) for f in files for g in range(f.num_row_groups) if (s := f.row_group(g).column(column).statistics)]
        assert sum(low <= value <= high for low, high in ranges) <= len(ranges) // 2
    empty = layout.write_interleaved(df.limit(0), str(tmp_path / "e"), ["a", "b"], 4)
    assert empty.count() == 0 and empty.columns == df.columns


def test_range_numbers_bisect(spark):
    df = spark.createDataFrame([(x,) for x in (None, -5, 1, 2, 3, 99)], "x int")
    assert [r.p for r in df.select(layout._place("x", [1, 2, 3]).alias("p")).collect()] == [0, 0, 1, 2, 3, 3]


def test_a_cut_frame_leaves_no_shuffle_files(spark):
    def files():
        return {f for d, _, names in os.walk(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir())) if "blockmgr-" in d for f in names if f.startswith("shuffle_")}

    frame = spark.range(1000).withColumn("k", F.col("id") % 7)
    before = files()
    with shuffles_go(spark):
        joined = frame.groupBy("k").count().join(frame.groupBy("k").agg(F.sum("id").alias("s")), "k")
        got = cut(joined)
    for _ in range(50):  # they are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and sorted(got.collect()) == sorted(joined.collect()) and got.columns == joined.columns
