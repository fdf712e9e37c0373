"""Lists, pages and look-ups of photos, clusters and persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.functions.constants import SORTABLE
from mediaweave.operators.ranking import global_rank, rank_in_group


def photo_filter(level: int | None = None, category: str | None = None, decision: str | None = None, cluster_id: int | None = None) -> Column:
    """A predicate: at least the level, and equal to what else is given. An empty string is no filter; decision "none"
    means no decision."""
    keep = F.lit(True)
    if level is not None:
        keep &= F.col("processing_level") >= level
    if category:
        keep &= F.col("content_category") == category
    if decision:
        keep &= F.col("user_decision").isNull() if decision == "none" else F.col("user_decision") == decision
    if cluster_id is not None:
        keep &= F.col("cluster_id") == cluster_id
    return keep


def sort_key(sort_by: str, sort_dir: str) -> tuple[str, bool]:
    """The column to sort by, exif_date if it isn't allowed, and whether it is descending."""
    return (sort_by if sort_by in SORTABLE else "exif_date"), sort_dir.upper() == "DESC"


def photo_page(photos: DataFrame, limit: int = 100, offset: int = 0, sort_by: str = "exif_date", sort_dir: str = "ASC", **filters) -> DataFrame:
    """A page of 1 to 1000 photos, nulls first upwards and last downwards, ties by id."""
    column, down = sort_key(sort_by, sort_dir)
    order = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_first()
    return photos.filter(photo_filter(**filters)).orderBy(order, "id").offset(offset).limit(max(1, min(limit, 1000)))


def table_position(photos: DataFrame, targets: DataFrame, sort_by: str = "exif_date", sort_dir: str = "ASC", page_size: int = 100, category: str | None = None) -> DataFrame:
    """targets: id. Where photos stand in the sorted, filtered list: id, row_index, page, found; (0, 0, false) if they
    don't. Ties go by id."""
    column, down = sort_key(sort_by, sort_dir)
    kept = photos.filter(photo_filter(category=category)).select("id", F.col(column).alias("v"))
    ranked = global_rank(kept, F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_first(), F.col("id").asc(), name="i").select("id", "i")
    out = targets.select("id").join(ranked, "id", "left")
    return out.select("id", F.coalesce("i", F.lit(0)).alias("row_index"), F.coalesce(F.expr(f"i DIV {page_size}"), F.lit(0)).alias("page"), F.col("i").isNotNull().alias("found"))


def cluster_photo_chunks(photos: DataFrame, wanted: DataFrame, size: int = 10_000) -> DataFrame:
    """wanted: cluster_id. Each with its photos' ids by (rank, id), at most size of them a row, however large the cluster:
    cluster_id, chunk (from 0), ids; an unknown cluster has one empty list."""
    members = photos.join(wanted, "cluster_id", "left_semi").select("cluster_id", "id", "rank_in_cluster")
    placed = rank_in_group(members, "cluster_id", F.col("rank_in_cluster").asc_nulls_first(), F.col("id").asc())
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    lists = placed.groupBy("cluster_id", F.expr(f"cast((place - 1) DIV {size} AS INT)").alias("chunk")).agg(ids.alias("ids"))
    return wanted.join(lists, "cluster_id", "left").select("cluster_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def cluster_photo_ids(photos: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same in one row a cluster, for those whose photos fit one: cluster_id, ids."""
    whole = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    chunks = cluster_photo_chunks(photos, wanted).groupBy("cluster_id").agg(whole.alias("chunks"))
    return chunks.select("cluster_id", F.flatten(F.transform("chunks", lambda x: x["ids"])).alias("ids"))


def cluster_listing(clusters: DataFrame, photos: DataFrame, nonempty: bool = True) -> DataFrame:
    """Clusters with their photos' count and ids (in order, by commas), whether one is an exact duplicate, and the best
    photo's name and measures. Where the ids are not selected, Spark does not gather them."""
    ids = F.array_join(F.array_sort(F.collect_list("id")), ",").alias("photo_ids")
    members = photos.groupBy("cluster_id").agg(ids, F.count("*").alias("actual_count"), F.max("is_exact_duplicate").alias("has_exact_dup"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    best = photos.select(F.col("id").alias("best_photo_id"), "original_filename", "quality_blur", "quality_exposure")
    joined = clusters.join(members.withColumnRenamed("cluster_id", "id"), "id", "inner" if nonempty else "left").join(best, "best_photo_id", "left")
    return joined.select("id", "name", "type", F.coalesce("actual_count", F.lit(0)).alias("actual_count"), F.coalesce("has_exact_dup", F.lit(0)).alias("has_exact_dup"), "first_id", "last_id", "photo_ids", "best_photo_id", "original_filename", "quality_blur", "quality_exposure", "avg_timestamp")


def cluster_badges(listing: DataFrame) -> DataFrame:
    """Marks for a cluster's cell: dup, blurry, over or under exposed; a missing measure gives none."""
    marks = F.array(
        F.when((F.col("type") == "dup") | (F.col("has_exact_dup") == 1), "dup"),
        F.when(F.col("quality_blur") < 100, "blur"),
        F.when(F.col("quality_exposure") > 220, "over"),
        F.when(F.col("quality_exposure") < 50, "under"),
    )
    return listing.select("id", F.array_join(F.array_compact(marks), ",").alias("badges"))


def cluster_gallery(listing: DataFrame) -> DataFrame:
    """The order of the gallery: clusters without a time come last."""
    return listing.orderBy(F.nullif(F.col("avg_timestamp"), F.lit("")).asc_nulls_last(), "id")


def person_listing(persons: DataFrame, include_hidden: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    shown = persons if include_hidden else persons.filter("NOT hidden")
    return shown.orderBy(F.desc("face_count"), "id").offset(offset).limit(limit)


def pending_ids(after: DataFrame, before: DataFrame) -> DataFrame:
    """Photos that the next stage takes: under level 2 now, or at level 1 before, each once."""
    return after.filter("processing_level < 2").select("id").unionByName(before.filter("processing_level = 1").select("id")).dropDuplicates(["id"])
