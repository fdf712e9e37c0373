from __future__ import annotations

from math import acos, cos, sin

import numpy as np
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.operators import faces as A
from mediaweave.operators import vectors as W
from mediaweave.operators.places import nearest_place

FACE = "id long, photo_id long, person_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double, embedding array<double>"


def of(similarity):
    a = acos(similarity)
    return [cos(a), sin(a)]


def search(spark, *rows):
    vectors = spark.createDataFrame([(i, of(s), t) for i, (s, t) in enumerate(rows)], "photo_id long, embedding array<double>, is_technical int")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    return [(r.photo_id, r.similarity) for r in W.vector_search(vectors, query).orderBy("rank").collect()]


def test_search(spark):
    assert search(spark, (0.30, 1), (0.30, 0)) == [(1, 0.3), (0, 0.2)]
    assert search(spark, (0.40, 1)) == [(0, 0.3)]
    assert search(spark, (0.22, 1)) == []
    assert search(spark, (0.22, 0)) == [(0, 0.22)]
    assert search(spark) == []


def test_classify_ties_go_to_the_first(spark):
    prototypes = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "c", [0.0, 1.0])], "ordinal int, category string, centroid array<double>")
    vectors = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.1, 1.0]), (3, None)], "photo_id long, embedding array<double>")
    got = {r.photo_id: (r.category, r.is_technical) for r in W.classify(vectors, prototypes, ["a"]).collect()}
    assert got == {1: ("a", 1), 2: ("c", 0)}


def test_blocks_don_t_change_neighbours(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(120)], "id long, embedding array<double>")
    one, many = (sorted(map(tuple, W.nearest_neighbours(df, 5, 0.2, block).select("id", "neighbour", "rank").collect())) for block in (1000, 17))
    assert one == many and one


def faces(spark, vectors):
    return spark.createDataFrame([(i + 1, i + 1, None, 0.1, 0.1, 0.2, 0.2, 0.9, v) for i, v in enumerate(vectors)], FACE)


OLD = "name string, hidden boolean, representative_face_id long"


def test_persons(spark):
    none = spark.createDataFrame([], OLD)
    same, apart = [[1.0, 0.0, 0.0]] * 3, np.eye(3).tolist()
    assert [r.face_count for r in A.persons(faces(spark, same), none).collect()] == [3]
    assert [r.face_count for r in A.persons(faces(spark, apart), none).collect()] == [1, 1, 1]
    named = spark.createDataFrame([("Ann", True, 2), (None, False, 1)], OLD)
    row = A.persons(faces(spark, same), named).first()
    assert (row.id, row["name"], row.hidden, row.representative_face_id) == (1, "Ann", True, 1) and len(row.centroid) == 3


def test_inference_survives_bad_rows(spark):
    def load():
        def model(xs):
            if "bad" in xs:
                raise ValueError
            return [None if x == "none" else [float(len(x))] for x in xs]

        return model

    got = {r.id: (r.embedding, r.failed) for r in W.batch_inference(spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "none")], "id long, text string").coalesce(1), "text", load).collect()}
    assert got == {1: ([2.0], False), 2: (None, True), 3: (None, False)}


def test_layers_fold_to_one(spark):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=4)), (rng.normal(size=(1, 4)), rng.normal(size=1))]
    w, b = S.fold_layers([(x.tolist(), y.tolist()) for x, y in layers])
    for v in rng.normal(size=(5, 3)):
        want = layers[1][0] @ (layers[0][0] @ v + layers[0][1]) + layers[1][1]
        assert abs(np.dot(w, v) + b - want[0]) < 1e-9
    got = spark.createDataFrame([([100.0, 0.0, 0.0],), ([-100.0, 0.0, 0.0],)], "v array<double>").select(S.affine_score(F.col("v"), F.array(*map(F.lit, [1.0, 0.0, 0.0])), F.lit(0.0))).collect()
    assert [r[0] for r in got] == [10.0, 1.0]


def test_translation(spark):
    df = spark.createDataFrame([("портрет",), ("Кот",), ("  чек ",), ("cat",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(W.translate(F.col("q"))).collect()] == ["portrait", "cat", "receipt", None, None, None]


def test_nearest_place_is_that_of_all_places(spark):
    rng = np.random.default_rng(9)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-89, 89, 60), rng.uniform(-180, 180, 60), strict=True))] + [(900, 10.0, None)]
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 25), rng.uniform(-180, 180, 25), strict=True))]
    p, q = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double")
    pairs = p.join(q.select("place_id", F.col("lat").alias("a"), F.col("lon").alias("b")), F.lit(True)).filter("lon IS NOT NULL")
    want = {r.id: r.place_id for r in pairs.groupBy("id").agg(F.min_by("place_id", S.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).alias("place_id")).collect()}
    assert {r.id: r.place_id for r in nearest_place(p, q).collect()} == want
