"""Cells: exact neighbours and search against all pairs, and how much work the triangle inequality saves."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaweave.operators import cells as C
from mediaweave.operators import vectors as W
from mediaweave.sources.shared import published_since


def clustered(n: int, centres: int, dims: int = 24, spread: float = 0.12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims)) / np.sqrt(dims)


def table_of(spark, m: np.ndarray, shape: str = "id long, embedding array<double>"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], shape)


def all_pairs(m: np.ndarray, k: int, least: float) -> set:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(length == 0, 1, length)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(m)):
        order = np.lexsort((np.arange(len(m)), -s[i]))[:k]
        out |= {(i, int(j), r + 1) for r, j in enumerate(order) if s[i, j] > least}
    return out


@pytest.mark.parametrize(("pivots", "size"), [(40, 16), (3, 1000), (40, 7)])
def test_neighbours_equal_all_pairs(spark, pivots, size):
    m = np.vstack([clustered(260, 20), np.zeros((2, 24)), np.repeat(clustered(1, 1, seed=9), 30, axis=0)])  # zeros, and many equal
    index = C.cell_index(table_of(spark, m), pivots, size)
    found, _ = C.neighbours(index, 6, 0.3, size)
    got = {(r.id, r.neighbour, r["rank"]) for r in found.collect()}
    same = lambda rows: {x for x in rows if x[0] < 262}  # noqa: E731 equal vectors' scores may differ in the last bit
    assert same(got) == same(all_pairs(m, 6, 0.3)) and len(got) == len(all_pairs(m, 6, 0.3))
    assert index.units.agg(F.max("n")).first()[0] <= 2 * size


def test_clustered_vectors_meet_few_others(spark):
    n = 4000
    m = clustered(n, 60)
    index = C.cell_index(table_of(spark, m), 64, 64)
    found, visits = C.neighbours(index, 5, 0.6, 64)
    assert {(r.id, r.neighbour) for r in found.collect()} == {x[:2] for x in all_pairs(m, 5, 0.6)}
    compared = visits.agg(F.sum("n")).first()[0] + index.units.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert compared < 0.1 * n * n


def test_a_cell_with_most_vectors_is_cut(spark):
    m = np.vstack([np.tile([1.0, 0.0, 0.0], (500, 1)), np.eye(3)])
    index = C.cell_index(table_of(spark, m), 4, 50)
    assert index.units.agg(F.max("n"), F.sum("n")).first()[:] == (max(r.n for r in index.units.collect()), 503)
    assert index.units.agg(F.max("n")).first()[0] < 100
    found, _ = C.neighbours(index, 3, 0.5, 50)
    assert found.groupBy("id").count().filter("count = 3").count() == 501


def searched(m, queries, technical, least, limit, penalty):
    u, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (m, queries))
    s = q @ u.T - penalty * technical
    out = set()
    for i in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(m)), -s[i])) if s[i, j] >= least][:limit]
        out |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    return out


def test_a_stored_index_gives_exact_hits_and_reads_few_cells(spark, tmp_path):
    m, queries = clustered(1500, 30), clustered(40, 30, seed=5)[:9]
    technical = np.arange(1500) % 4 == 0
    df = spark.createDataFrame([(i, x.tolist(), int(t)) for i, (x, t) in enumerate(zip(m, technical, strict=True))], "photo_id long, embedding array<double>, is_technical int")
    path = str(tmp_path / "index")
    C.write_index(W.searchable(df), path, 32, 64)
    with pytest.raises(FileExistsError):
        C.write_index(W.searchable(df), path, 32, 64)
    index = C.read_index(spark, path)
    asked = table_of(spark, queries, "query_id long, embedding array<double>")
    for least, limit in ((0.18, 200), (0.5, 3), (-1.0, 5)):
        got = {(r.query_id, r.photo_id, r["rank"]) for r in W.search_index(index, asked, least, 0.1, limit).collect()}
        assert got == searched(m, queries, technical, least, limit, 0.1)
    one = C.only_cells(index, index.units.orderBy("unit").limit(1))
    assert re.search(r"PartitionFilters: \[[^\]]*cell", one._jdf.queryExecution().toString())
    near = C.candidates(asked.select(F.col("query_id").alias("id"), "embedding", F.lit(0.6).alias("reach")), index)
    assert near.select("id", "unit").count() < 0.5 * 9 * index.units.count()


def test_nothing_to_find(spark):
    none, one = table_of(spark, np.zeros((0, 3))), table_of(spark, np.ones((1, 3)))
    assert W.nearest_neighbours(none).collect() == [] and W.nearest_neighbours(one).collect() == []
    vectors = spark.createDataFrame([], "photo_id long, embedding array<double>, is_technical int")
    queries = table_of(spark, np.ones((2, 3)), "query_id long, embedding array<double>")
    assert W.vector_search(vectors, queries).collect() == []
    known = spark.createDataFrame([(1, [1.0, 0.0, 0.0], None), (2, None, 1)], "photo_id long, embedding array<double>, is_technical int")
    assert W.vector_search(known, queries.limit(0)).collect() == []
    assert [(r.query_id, r.photo_id) for r in W.vector_search(known, queries).orderBy("query_id").collect()] == [(0, 1), (1, 1)]


def test_neighbours_carry_a_vector_once_a_block_and_not_once_a_unit(spark):
    m = np.random.default_rng(4).normal(size=(400, 16))  # noise: nothing is ruled out
    index = C.cell_index(table_of(spark, m), 20, 10)
    with published_since() as paths:
        found, visits = C.neighbours(index, 4, 0.1, 10)
    assert {(r.id, r.neighbour, r["rank"]) for r in found.collect()} == all_pairs(m, 4, 0.1)
    written = [t for t in map(spark.read.parquet, paths) if {"block", "unit", "slice"} <= set(t.columns)]
    assert visits.count() > 10_000 and [t.count() < 1000 for t in written] == [True]
