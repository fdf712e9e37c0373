"""Plans at size: what the planner may take for small because it is compressed, or because it does not count exploded rows."""

from __future__ import annotations

import itertools
import math
import random

import duckdb

from mediaweave.operators import clusters as C
from mediaweave.operators import mutate as M
from mediaweave.operators import pairs as P
from mediaweave.operators.places import nearest_place
from mediaweave.plans import queries_vectors
from mediaweave.sources.schemas import read_table
from mediaweave.sources.shared import published_since
from tests.test_clusters import HERE, PHOTO, at, photo
from tests.test_oracles import rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def library(spark):
    rows = [photo(i, at(i % 50) if i % 3 else None, HERE if i % 2 else None, f"{i % 5:016x}") for i in range(60)]
    return spark.createDataFrame(rows, PHOTO)


def test_no_exploded_side_of_similarity_edges_is_copied(spark):
    assert "BroadcastExchange" not in plan(P.similarity_edges(library(spark)))


def test_no_exploded_side_of_incremental_match_is_copied(spark):
    photos = library(spark).selectExpr("*", "id AS cluster_id")
    assert "BroadcastExchange" not in plan(P.incremental_match(photos.filter("id % 4 = 0"), photos.filter("id % 4 <> 0")))


def test_embedding_pairs_meet_in_parts_of_blocks_and_fetch_no_vectors(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2000), *rng.choice([(55.0, 37.0), (55.0002, 37.0), (56.0, 37.0), (None, None), (55.0, None)]), [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    found = C.embedding_pairs(spark.createDataFrame(rows, "id long, secs long, lat double, lon double, embedding array<double>"), 0.3, 180, 50, size=2)
    assert "CoGroups" in plan(found) and "embedding_a" not in plan(found)

    def agree(x, y):
        both = None not in (x[2], x[3], y[2], y[3])
        cosine = sum(p * q for p, q in zip(x[4], y[4], strict=True)) / math.hypot(*x[4]) / math.hypot(*y[4])
        return abs(x[1] - y[1]) <= 180 and cosine >= 0.3 and (not both or abs(x[2] - y[2]) < 0.0003)

    assert sorted((r.a, r.b) for r in found.collect()) == sorted((x[0], y[0]) for x, y in itertools.combinations(rows, 2) if agree(x, y))


def test_of_places_at_one_spot_only_one_meets_points(spark):
    places = spark.createDataFrame([(i, 55.0, 37.0, f"p{i}") for i in range(9, 0, -1)], "place_id long, lat double, lon double, name string")
    with published_since() as paths:
        found = nearest_place(spark.createDataFrame([(1, 55.001, 37.001)], "id long, lat double, lon double"), places).collect()
    assert [(r.place_id, r.name) for r in found] == [(1, "p1")]
    assert [t.count() for t in map(spark.read.parquet, paths) if "place_lat" in t.columns] == [1]


def test_search_routed_looks_a_vector_up_once(spark, tmp_path):
    for name in ("embeddings", "events", "conversations"):
        given = read_table(spark, f"/root/testdata/sf0.001/{name}.parquet", name)
        (given.unionAll(given.filter("turn < 2")) if name == "conversations" else given).write.parquet(str(tmp_path / f"{name}.parquet"))
    with published_since() as paths:
        found = queries_vectors.search_routed(spark, str(tmp_path)).toPandas()
    asked = [t for t in map(spark.read.parquet, paths) if t.columns == ["id", "embedding"]]
    assert [t.count() for t in asked] == [found[found.route == "vector"].query_id.mod(500).nunique()]
    con = duckdb.connect()
    for name in ("embeddings", "events", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert rows(found) == rows(con.sql(queries_vectors.ORACLES["search_routed"]).df())


def test_photos_are_not_copied_to_find_orphan_clusters(spark):
    photos, clusters = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id long, cluster_id long"), spark.createDataFrame([(5,), (6,), (None,)], "id long")
    kept, gone = M.drop_orphan_clusters(clusters, photos), M.orphan_clusters(clusters, photos)
    assert "BroadcastExchange" not in plan(kept) + plan(gone) and "HashAggregate" in plan(kept)
    assert [r.id for r in kept.collect()] == [5] and sorted(str(r.id) for r in gone.collect()) == ["6", "None"]
