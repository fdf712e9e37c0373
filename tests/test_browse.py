from __future__ import annotations

from pyspark.sql import functions as F

from mediaweave.operators import browse as B
from mediaweave.operators import mutate as M
from mediaweave.operators import stats as T
from mediaweave.operators.ranking import rank_in_group

PHOTO = "id long, processing_level int, content_category string, user_decision string, cluster_id long, exif_date string"
ROWS = [(1, 0, "food", None, 1, None), (2, 1, "food", "keep", 1, "b"), (3, 2, None, "keep", None, "a"), (4, 3, "book", None, 2, "a")]


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(spark):
    photos = spark.createDataFrame(ROWS, PHOTO)
    assert ids(photos.filter(B.photo_filter(level=1))) == [2, 3, 4]
    assert ids(photos.filter(B.photo_filter(decision="none"))) == [1, 4]
    assert ids(photos.filter(B.photo_filter(category="food", decision="keep"))) == [2]
    assert ids(photos.filter(B.photo_filter(category="", decision="", cluster_id=2))) == [4]


def test_pages(spark):
    photos = spark.createDataFrame(ROWS, PHOTO)
    assert ids(B.photo_page(photos)) == [1, 3, 4, 2]
    assert ids(B.photo_page(photos, sort_by="exif_date; DROP TABLE", sort_dir="desc", limit=2, offset=1)) == [3, 4]
    targets = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    got = {r.id: (r.row_index, r.page, r.found) for r in B.table_position(photos, targets, page_size=2).collect()}
    assert got == {1: (0, 0, True), 3: (1, 0, True), 4: (2, 1, True), 2: (3, 1, True), 9: (0, 0, False)}


def test_ranks_in_a_group_that_is_everything(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id")).repartition(7)
    got = {r.id: r.place for r in rank_in_group(df, "g", F.desc("id")).collect()}
    assert got == {i: 5000 - i for i in range(5000)}


def test_cluster_lists(spark):
    photos = spark.createDataFrame([(1, 1, 2), (2, 1, None), (3, 1, 1)], "id long, cluster_id long, rank_in_cluster int")
    got = {r.cluster_id: r.ids for r in B.cluster_photo_ids(photos, spark.createDataFrame([(1,), (5,)], "cluster_id long")).collect()}
    assert got == {1: [2, 3, 1], 5: []}


def test_level_info_of_nothing(spark):
    row = T.level_info(spark.createDataFrame([(1, "disconnected")], "processing_level int, sync_status string"))
    assert (row.first().min_level, row.first().active, row.first().disconnected) == (0, 0, 1)


def test_deleting_a_photo(spark):
    photos = spark.createDataFrame([(1, 10), (2, 20)], "id long, cluster_id long")
    faces = spark.createDataFrame([(5, 1, 7), (6, 2, 8)], "id long, photo_id long, person_id long")
    left = M.cascade_delete(
        spark.createDataFrame([(1,)], "id long"), photos, spark.createDataFrame([(1,), (2,)], "photo_id long"), faces, spark.createDataFrame([(10, 1), (20, 1)], "id long, best_photo_id long"),
        operations=spark.createDataFrame([(1, "move"), (2, "move")], "photo_id long, operation_type string"), corrections=spark.createDataFrame([(1, "x")], "photo_id long, field string"),
        face_vectors=spark.createDataFrame([(5,), (6,)], "face_id long"), persons=spark.createDataFrame([(7, "Ann", 1, 5), (8, "Bob", 9, 5)], "id long, name string, face_count long, representative_face_id long"),
    )
    got = {k: [tuple(r) for r in df.collect()] for k, df in left.items()}
    assert got["photos"] == [(2, 20)] and got["vectors"] == [(2,)] and got["clusters"] == [(20, None)] and got["corrections"] == [] and got["face_vectors"] == [(6,)]
    assert sorted(got["operations"], key=str) == sorted([(None, "move"), (2, "move")], key=str) and got["persons"] == [(8, "Bob", 1, None)]


def test_quality(spark):
    photos = spark.createDataFrame([(1, "a", 5.0, 5.0, 0, None), (2, "b", 5.0, 5.0, 2, 9)], "id long, perceptual_hash string, quality_blur double, quality_exposure double, processing_level int, exif_width int")
    measured = spark.createDataFrame([(1, True, "c", 1.0, 2.0, 7), (2, False, None, 1.0, 2.0, 7)], "id long, ok boolean, perceptual_hash string, quality_blur double, quality_exposure double, exif_width int")
    assert [tuple(r) for r in M.apply_quality(photos, measured).orderBy("id").collect()] == [(1, "c", 1.0, 2.0, 1, 7), (2, "b", None, None, 2, 9)]


def test_runs_are_appended(spark, tmp_path):
    runs = spark.createDataFrame([("l1", 2.0, 10), ("l1", 0.0, 10)], "stage string, duration_s double, items long")
    T.append_runs(runs, str(tmp_path / "log"))
    T.append_runs(runs, str(tmp_path / "log"))
    assert sorted(str(r.rate) for r in T.stage_rates(spark.read.parquet(str(tmp_path / "log"))).collect()) == ["5.0", "5.0", "None", "None"]


def test_a_cluster_of_all_photos_is_never_one_row(spark):
    photos = spark.range(1000).select(F.col("id"), F.lit(7).cast("long").alias("cluster_id"), (F.col("id") % 3).cast("int").alias("rank_in_cluster"))
    wanted = spark.createDataFrame([(7,), (8,)], "cluster_id long")
    got = B.cluster_photo_chunks(photos, wanted, 64).orderBy("cluster_id", "chunk").collect()
    assert max(len(r.ids) for r in got) == 64 and (got[-1].cluster_id, got[-1].chunk, got[-1].ids) == (8, 0, [])
    whole = [i for r in got for i in r.ids]
    assert whole == sorted(range(1000), key=lambda i: (i % 3, i)) == {r.cluster_id: r.ids for r in B.cluster_photo_ids(photos, wanted).collect()}[7]
