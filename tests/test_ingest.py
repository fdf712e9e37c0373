from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.operators import mutate as M
from mediaweave.plans import catalog, queries_ingest
from mediaweave.sources import ingest as I
from mediaweave.sources import schemas, shared
from mediaweave.streaming import ingest as stream
from tests.test_clusters import PHOTO, at, photo


def test_listing(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.jpg", "deep/B.JPG", "c.txt", "noext"):
        (tmp_path / name).write_bytes(name.encode())
    found = {r.path.rsplit("/", 1)[1]: r for r in I.hashed_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.jpg", "B.JPG"} and found["a.jpg"].content_hash == hashlib.sha256(b"a.jpg").hexdigest()
    assert "content" not in I.file_listing(spark, str(tmp_path)).columns


def test_new_rows(spark):
    shape = "id long, content_hash string, original_path string"
    rows, stored = spark.createDataFrame([(1, "h", "/a"), (2, "h", "/a"), (3, "h", "/b"), (4, "x", "/c")], shape), spark.createDataFrame([(9, "x", "/c")], shape)
    assert sorted(r.id for r in I.new_rows(rows, stored).collect()) == [1, 3]
    assert tuple(I.ingest_report(rows, stored).select("scanned", "new", "skipped").first()) == (4, 2, 2)


def test_paths(spark):
    paths = spark.createDataFrame([("/lib/a/x.jpg",), ("/lib/ab/x.jpg",), ("/lib/a",), ("/else",)], "path string")
    got = {r.path: r.accepted for r in I.within_sources(paths, spark.createDataFrame([("/lib/a",)], "path string")).collect()}
    assert got == {"/lib/a/x.jpg": True, "/lib/ab/x.jpg": False, "/lib/a": True, "/else": False}


def test_scalars(spark):
    df = spark.createDataFrame([("a.b.jpg",), ("noext",), (".hidden",)], "f string")
    assert [r[0] for r in df.select(S.stem(F.col("f"))).collect()] == ["a.b", "noext", ""]
    zero = spark.range(1).select(S.dms_to_decimal(*(F.struct(F.lit(n).cast("double").alias("num"), F.lit(d).cast("double").alias("den")) for n, d in ((10, 1), (30, 1), (0, 0))), F.lit("N")))
    assert zero.first()[0] is None


def test_updates_are_checked(spark):
    df = spark.createDataFrame([(1, "keep")], "id long, user_decision string")
    with pytest.raises(ValueError):
        M.apply_updates(df, spark.createDataFrame([(1, "x")], "id long, original_path string"), "photos")
    assert M.apply_updates(df, spark.createDataFrame([(1, None)], "id long, user_decision string"), "photos").first().user_decision is None


def test_batches_that_arrive_in_turn(spark, tmp_path):
    """Two batches: what arrives later joins what is stored, and nothing is stored twice."""
    shape = PHOTO + ", content_hash string, original_path string"
    first = [(*photo(1, at(0)), "a", "/1"), (*photo(2, at(30)), "b", "/2"), (*photo(3, at(30)), "b", "/2")]
    second = [(*photo(4, at(1)), "c", "/4"), (*photo(5, at(59)), "a", "/1"), (*photo(6, at(59, 30)), "d", "/6")]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    arriving = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stored = stream.stream_ingest(arriving(), lambda df: df.select("id", "content_hash", "original_path"), str(tmp_path / "rows"))
    assert stored.count() == stored.select("content_hash", "original_path").distinct().count() == 4
    found = {r.id: r.cluster_id for r in stream.stream_clusters(arriving(), lambda df: df, str(tmp_path / "clusters")).collect()}
    assert len(found) == 6 and found[2] == found[3] == 2 and found[4] == found[1] and found[5] == found[6]


def test_all_queries_have_names():
    assert len(catalog.QUERIES) > 90 and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_published_tables_can_go(spark):
    from mediaweave.sources import shared

    kept = shared.publish(spark.range(5))
    assert kept.count() == 5 and shared.remove_published(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        kept.count()


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "vectors")

    def fails(path):
        spark.range(5).write.parquet(path)
        raise RuntimeError("model")

    with pytest.raises(RuntimeError):
        shared.staged(spark, target, fails)
    assert not list(tmp_path.iterdir())
    shared.staged(spark, target, lambda path: spark.range(5).write.parquet(path))
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(FileExistsError):
        shared.staged(spark, target, lambda path: spark.range(6).write.parquet(path))
    assert [x.name for x in tmp_path.iterdir()] == ["vectors"] and spark.read.parquet(target).count() == 5


def test_photos_are_read_by_their_schema_in_order(spark, tmp_path):
    spark.createDataFrame([(2, "2020"), (1, "2020"), (3, None)], "id long, exif_date string").write.parquet(str(tmp_path / "p"))
    photos = schemas.read_photos(spark, str(tmp_path / "p"))
    assert [r.id for r in photos.collect()] == [3, 1, 2] and photos.schema == schemas.schema_of("photos")


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Four files in two runs: keys of the first run are known in the second, and no file is read twice."""
    shape, source, path = "id long, content_hash string, original_path string", tmp_path / "in", str(tmp_path / "out")
    provider = spark.conf.get(stream.STORE, None)
    for run, files in enumerate(([[(1, "a", "/1"), (2, "b", "/2")], [(3, "a", "/1")]], [[(4, "b", "/2"), (5, "c", None)], [(6, "c", None), (7, "d", "/7"), (8, "d", "/7")]])):
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(source / f"{run}{i}"))
        stored = stream.stream_ingest(stream.arriving_files(spark, str(source), schemas.StructType.fromDDL(shape)), lambda df: df, path)
    assert sorted((r.content_hash, r.original_path) for r in stored.collect()) == [("a", "/1"), ("b", "/2"), ("c", None), ("d", "/7")]
    assert len(list((tmp_path / "out" / "rows").glob("batch=*"))) == 4 and spark.conf.get(stream.STORE, None) == provider


def test_links_that_arrive_in_batches(spark, tmp_path):
    links = [[(1, 2), (8, 9)], [(5, 6), (6, 7)], [(2, 5), (3, 3)], [(9, 1), (20, 21)]]
    for i, rows in enumerate(links):
        spark.createDataFrame(rows, "a long, b long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    labels, merges = stream.stream_components(stream.arriving_files(spark, str(tmp_path / "in"), schemas.StructType.fromDDL("a long, b long")), str(tmp_path / "out"))
    assert {r.node: r.component for r in labels.collect() if r.node != 3} == dict.fromkeys([1, 2, 5, 6, 7, 8, 9], 1) | {20: 20, 21: 20}
    assert {(r.was, r.now) for r in merges.collect()} == {(5, 1), (8, 1)}
    assert len({r.batch for r in merges.collect()}) == 2


def test_files_of_a_batch_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    paths = iter([str(tmp_path / "arriving"), str(tmp_path / "stream")])
    monkeypatch.setattr(queries_ingest, "scratch_path", lambda spark: next(paths))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "60000b")
    try:
        parts = queries_ingest.V.table(spark, "/root/testdata/sf0.001", "documents").rdd.getNumPartitions()
        found = queries_ingest.stream_ingest(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 1 and len(list((tmp_path / "arriving").glob("*.parquet"))) > 5
    assert len(list((tmp_path / "stream" / "rows").glob("batch=*"))) <= 5 and found
