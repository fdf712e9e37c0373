"""Vector search, classification, nearest neighbours and batch scoring.

Search and neighbours go through cells (operators/cells.py); scores are computed with numpy inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.functions.constants import FACE_NEIGHBOURS, FACE_SIMILARITY, QUERY_LENGTH, SEARCH_LIMIT, SEARCH_PENALTY, SEARCH_THRESHOLD, TERMS
from mediaweave.operators import cells

def unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else np.ones((0, 1))
    return m / np.where(length == 0, 1, length)


def searchable(vectors: DataFrame) -> DataFrame:
    """vectors: photo_id, embedding, is_technical. As an index takes them."""
    return vectors.select(F.col("photo_id").alias("id"), "embedding", F.coalesce((F.col("is_technical") == 1).cast("int"), F.lit(0)).alias("penalised"))


def search_index(index: cells.Index, queries: DataFrame, threshold: float = SEARCH_THRESHOLD, penalty: float = SEARCH_PENALTY, limit: int = SEARCH_LIMIT) -> DataFrame:
    """queries: query_id, embedding. For each query the limit most similar photos at or above the threshold, technical ones
    with a penalty: query_id, photo_id, similarity, rank."""
    found = cells.search(index, queries.select(F.col("query_id").alias("id"), "embedding"), threshold, limit, penalty)
    return found.select(F.col("id").alias("query_id"), F.col("neighbour").alias("photo_id"), F.round("similarity", 4).alias("similarity"), "rank")


def vector_search(vectors: DataFrame, queries: DataFrame, threshold: float = SEARCH_THRESHOLD, penalty: float = SEARCH_PENALTY, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The same over vectors (photo_id, embedding, is_technical) that have no stored index: one is made for this run."""
    return search_index(cells.cell_index(searchable(vectors)), queries, threshold, penalty, limit)


def translate(query: Column) -> Column:
    """The English term of a Cyrillic query that the dictionary has."""
    terms = F.create_map(*(F.lit(x) for pair in TERMS.items() for x in pair))
    return F.when(S.has_cyrillic(query), F.try_element_at(terms, F.trim(F.lower(query))))


def route_queries(queries: DataFrame, classes: list[str]) -> DataFrame:
    """queries: query_id, query. Adds text (trimmed, translated), category (where the text is a class) and route:
    category, vector, empty or rejected."""
    text = F.coalesce(translate(F.col("query")), F.trim("query"))
    routed = queries.withColumn("text", text).withColumn("category", F.when(F.lower("text").isin(classes), F.lower("text")))
    route = F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "empty").when(F.char_length(F.trim("query")) > QUERY_LENGTH, "rejected").when(F.col("category").isNotNull(), "category").otherwise("vector")
    return routed.withColumn("route", route)


def category_hits(routed: DataFrame, photos: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """For each query that names a class its photos by date: query_id, photo_id, similarity 1, rank."""
    hits = routed.filter("route = 'category'").join(photos.select("id", "exif_date", F.col("content_category").alias("category")), "category")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("exif_date", "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", F.col("id").alias("photo_id"), F.lit(1.0).alias("similarity"), "rank")


def vector_hits(routed: DataFrame, query_vectors: DataFrame, vectors: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """For each query on the vector route the photos nearest to its vector (query_vectors: query_id, embedding, as an
    embedder gives them): query_id, photo_id, similarity, rank. A query without a vector has no hits."""
    wanted = routed.filter("route = 'vector'").select("query_id").join(query_vectors, "query_id")
    return vector_search(vectors, wanted, limit=limit)


def mean_vectors(vectors: DataFrame, key: str, epsilon: float = 0.0, normalize: bool = True) -> DataFrame:
    """The mean of each key's (unit) vectors, over its length plus epsilon: key, centroid, n. Sums combine map-side."""
    v = vectors.filter(F.col("embedding").isNotNull()).select(key, F.posexplode(S.l2_normalize(F.col("embedding")) if normalize else F.col("embedding")).alias("pos", "x"))
    means = v.groupBy(key, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    lists = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("mean"), F.max("n").alias("n"))
    length = F.sqrt(S.dot(F.col("mean"), F.col("mean"))) + epsilon
    return lists.select(key, F.transform("mean", lambda x: x / F.when(length == 0, 1.0).otherwise(length)).alias("centroid"), "n")


def _classify(batches: Iterator[pd.DataFrame], prototypes) -> Iterator[pd.DataFrame]:
    names, matrix = prototypes.value
    for df in batches:
        df = df[df["embedding"].notna()]
        if len(df):
            scores = unit(df["embedding"]) @ matrix.T
            best = scores.argmax(1)  # the first of equals
            yield pd.DataFrame({"photo_id": df["photo_id"], "category": [names[i] for i in best], "score": scores[np.arange(len(df)), best]})


def classify(vectors: DataFrame, prototypes: DataFrame, technical: list[str]) -> DataFrame:
    """vectors: photo_id, embedding; prototypes: ordinal, category, centroid, one row a class of a fixed list. The most
    similar class, ties to the first: photo_id, category, score, is_technical."""
    rows = prototypes.orderBy("ordinal").collect()
    shared = vectors.sparkSession.sparkContext.broadcast(([r.category for r in rows], np.array([r.centroid for r in rows])))
    found = vectors.select("photo_id", "embedding").mapInPandas(partial(_classify, prototypes=shared), "photo_id long, category string, score double")
    return found.withColumn("is_technical", F.col("category").isin(technical).cast("int"))


def nearest_neighbours(vectors: DataFrame, k: int = FACE_NEIGHBOURS, least: float = FACE_SIMILARITY, block: int = cells.UNIT) -> DataFrame:
    """vectors: id, embedding. The k most similar others above least, exactly, ties by id: id, neighbour, similarity, rank.
    Vectors that the triangle inequality keeps apart never meet; block is the most that meet in a task."""
    return cells.neighbours(cells.cell_index(vectors.select("id", "embedding"), size=block), k, least, block)[0]


def _score(batches: Iterator[pd.DataFrame], load: Callable, column: str, held: dict) -> Iterator[pd.DataFrame]:
    model = held.setdefault("model", None) or load()
    held["model"] = model
    for df in batches:
        values, errors = [None] * len(df), [False] * len(df)
        try:
            values = list(model(df[column].tolist()))
        except Exception:  # one bad row must not cost the batch
            for i, x in enumerate(df[column]):
                try:
                    values[i] = list(model([x]))[0]
                except Exception:
                    errors[i] = True
        yield df.drop(columns=[column]).assign(embedding=[None if v is None else [float(x) for x in v] for v in values], failed=errors)


def batch_inference(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Scores a column with a model that load() makes once a task: batch by batch, or row by row where a batch fails.
    Adds embedding (null where the model fails or returns None) and failed; the column itself goes."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    return df.mapInPandas(partial(_score, load=load, column=column, held={}), f"{kept}, embedding array<double>, failed boolean")


def luma_quality(pixels: DataFrame) -> DataFrame:
    """pixels: photo_id, y, x, luma. Sharpness is the population variance of the 4-neighbour Laplacian over the pixels
    that have all four, exposure the mean: photo_id, quality_blur, quality_exposure."""
    row, column = Window.partitionBy("photo_id", "y").orderBy("x"), Window.partitionBy("photo_id", "x").orderBy("y")
    beside = F.lag("luma").over(row) + F.lead("luma").over(row) + F.lag("luma").over(column) + F.lead("luma").over(column)
    edges = pixels.withColumn("laplacian", beside - 4 * F.col("luma"))
    return edges.groupBy("photo_id").agg(F.var_pop("laplacian").alias("quality_blur"), F.avg("luma").alias("quality_exposure"))
