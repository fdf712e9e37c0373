"""Tables in buckets, and pages and positions from a stored order."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mediaweave.operators import browse as B
from mediaweave.operators import mutate as M
from mediaweave.operators import pages as P
from mediaweave.sources import buckets


def files(path) -> set[str]:
    return {str(p) for p in Path(path, "rows").rglob("*.parquet")}


def content(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def photos(spark, n=1000):
    return spark.range(n).select("id", F.lit(None).cast("string").alias("user_decision"), (F.col("id") % 4).cast("int").alias("processing_level"))


def test_a_change_of_a_bucket_writes_that_bucket_alone(spark, tmp_path):
    path, rows = str(tmp_path / "t"), photos(spark)
    buckets.create(rows, path, "id", 16)
    before = files(path)
    keys = rows.filter(buckets.bucket_of("id", 16) == 5).filter("id % 3 = 0").select("id", F.lit("keep").alias("user_decision"))
    m = buckets.change(spark, path, keys, lambda old, new: M.apply_updates(old, new, "photos"))
    added = files(path) - before
    assert m.version == 1 and added and before <= files(path) and all("/bucket=5/" in f for f in added)
    assert content(buckets.read(spark, path)) == content(M.apply_updates(rows, keys, "photos"))
    read = buckets.read(spark, path, keys)
    assert {f.removeprefix("file://") for f in read.inputFiles()} == added
    assert read.count() == rows.filter(buckets.bucket_of("id", 16) == 5).count()


def test_old_versions_go_and_a_change_of_nothing_makes_none(spark, tmp_path):
    path, rows = str(tmp_path / "t"), photos(spark, 200)
    buckets.create(rows, path, "id", 4)
    every = rows.select("id", F.lit(3).alias("processing_level"))
    buckets.change(spark, path, every, lambda old, new: M.apply_updates(old, new, "photos"))
    assert buckets.change(spark, path, every.limit(0), lambda old, new: old).version == 1
    assert buckets.remove_old(spark, path) == 4 and os.listdir(f"{path}/manifest") == ["version=1"]
    assert content(buckets.read(spark, path)) == content(M.apply_updates(rows, every, "photos"))


def test_a_failed_or_late_change_leaves_the_table_as_it_was(spark, tmp_path):
    path, rows = str(tmp_path / "t"), photos(spark, 100)
    buckets.create(rows, path, "id", 4)
    was, there = content(buckets.read(spark, path)), files(path)
    with pytest.raises(Exception, match="broken"):
        buckets.change(spark, path, rows, lambda old, new: old.withColumn("user_decision", F.raise_error(F.lit("broken"))))
    assert content(buckets.read(spark, path)) == was and files(path) == there
    one = rows.filter("id = 7")
    with pytest.raises(ValueError, match="don't name"):
        buckets.change(spark, path, one, lambda old, new: rows)
    assert files(path) == there

    def overtaken(old, new):
        buckets.change(spark, path, one, lambda o, n: buckets.delete_keys(o, n, "id"))
        return old.withColumn("processing_level", F.lit(9))

    with pytest.raises(FileExistsError):
        buckets.change(spark, path, rows, overtaken)
    assert content(buckets.read(spark, path)) == [r for r in was if r[0] != 7]


def test_null_keys_upserts_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], "id long, x string")
    buckets.create(empty, path, "id", 4)
    assert buckets.read(spark, path).collect() == []
    new = spark.createDataFrame([(1, "a"), (None, "b")], "id long, x string")
    buckets.change(spark, path, new, lambda old, rows: old.unionByName(rows))
    assert content(buckets.read(spark, path)) == content(new)
    buckets.change(spark, path, new.filter("id = 1"), lambda old, keys: buckets.delete_keys(old, keys, "id"))
    assert content(buckets.read(spark, path)) == [(None, "b")]
    with pytest.raises(ValueError):
        buckets.create(empty.withColumn("bucket", F.lit(1)), str(tmp_path / "u"), "id")


@pytest.mark.parametrize(("column", "direction"), [("exif_date", "asc"), ("exif_date", "desc"), ("quality_blur", "desc")])
def test_pages_and_positions_of_a_stored_order_are_those_of_the_sort(spark, tmp_path, column, direction):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.format_string("%03d", F.col("id") * 7 % 100)).alias("exif_date"), (F.col("id") % 11).cast("double").alias("quality_blur"))
    order = P.write_order(rows, str(tmp_path / "o"), column, direction, ranges=12)
    total = {"asc": F.col(column).asc_nulls_first(), "desc": F.col(column).desc_nulls_last()}[direction]
    want = [tuple(r) for r in rows.orderBy(total, "id").collect()]
    for offset, limit in ((0, 10), (2345, 100), (2990, 100), (3000, 5), (240, 1000)):
        assert [tuple(r) for r in P.page(order, limit, offset).collect()] == want[offset : offset + limit]
    assert [tuple(r) for r in P.page(P.read_order(spark, order.path), 7, 1234).collect()] == want[1234:1241]
    targets = rows.filter("id % 500 = 3").select("id").union(spark.createDataFrame([(9999,)], "id long"))
    assert content(P.positions(order, targets)) == content(B.table_position(rows, targets, column, direction))


def test_a_page_reads_its_ranges_and_a_position_its_buckets(spark, tmp_path):
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("exif_date"))
    order = P.write_order(rows, str(tmp_path / "o"), ranges=20)
    assert {f.split("order_range=")[1].split("/")[0] for f in P.page(order, 10, 4000).inputFiles()} <= {str(r) for r in range(20)}
    assert len({Path(f).parent for f in P.page(order, 10, 4000).inputFiles()}) <= 2 < order.ranges.count()
    plan = P.positions(order, rows.filter("id = 4321").select("id"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_bucket" in plan or "PartitionFilters: [(order_bucket" in plan


def test_an_empty_order(spark, tmp_path):
    order = P.write_order(spark.createDataFrame([], "id long, exif_date string"), str(tmp_path / "o"))
    assert P.page(order).collect() == []
    assert [tuple(r) for r in P.positions(order, spark.createDataFrame([(1,)], "id long")).collect()] == [(1, 0, 0, False)]
