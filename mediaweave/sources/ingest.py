"""Files, metadata and incoming rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.functions.constants import PHOTO_EXTENSIONS


def with_extension(files: DataFrame, extensions: tuple[str, ...] = PHOTO_EXTENSIONS) -> DataFrame:
    """files: path. Those with one of the extensions, in any case."""
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(list(extensions)))


def file_listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = PHOTO_EXTENSIONS) -> DataFrame:
    """Files of a folder and all below it with one of the extensions, in any case: path, length, modified. Their content
    isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_extension(files, extensions).select("path", "length", F.col("modificationTime").alias("modified"))


def hashed_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = PHOTO_EXTENSIONS) -> DataFrame:
    """The same with content_hash, the SHA-256 of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_extension(files, extensions).select("path", "length", F.sha2("content", 256).alias("content_hash"))


KEY = ["content_hash", "original_path"]


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Incoming rows whose key isn't stored, one a key (the first by id)."""
    first = incoming.groupBy(*key).agg(F.min("id").alias("id"))
    return incoming.join(first.select("id", *(F.col(k).alias(f"first_{k}") for k in key)), "id").drop(*(f"first_{k}" for k in key)).join(stored.select(*key), key, "left_anti")


def ingest_report(incoming: DataFrame, stored: DataFrame, key: list[str] = KEY) -> DataFrame:
    """scanned, new and skipped of a batch, in one row."""
    known = stored.select(*key, F.lit(True).alias("known")).dropDuplicates(key)
    marked = incoming.groupBy(*key).agg(F.count("*").alias("n")).join(known, key, "left")
    return marked.agg(F.sum("n").alias("scanned"), F.count_if(F.col("known").isNull()).alias("new")).withColumn("skipped", F.col("scanned") - F.col("new"))


def register_sources(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored sources and new ones by path, whose name is the path's last part."""
    new = paths.select("path").distinct().join(stored.select("path"), "path", "left_anti").select("path", S.base_name(F.col("path")).alias("name"))
    return stored.select("path", S.base_name(F.col("path")).alias("name")).unionByName(new)


def within_sources(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """paths: path. Adds accepted: whether a source is the path or a folder above it. Each path is joined by all the
    folders above it, an equi-join however many sources there are."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = paths.select("path").distinct().select("path", F.explode(above).alias("source")).join(sources.select(F.col("path").alias("source")).distinct(), "source").select("path", F.lit(True).alias("hit")).distinct()
    return paths.join(hit, "path", "left").withColumn("accepted", F.coalesce("hit", F.lit(False))).drop("hit")


def sync_check(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """photos with sync_status: ok if the effective path is in the listing (path), else disconnected."""
    there = listing.select(F.col("path").alias("effective"), F.lit(True).alias("there")).distinct()
    marked = photos.withColumn("effective", S.effective_path(F.col("current_path"), F.col("original_path"))).join(there, "effective", "left")
    return marked.withColumn("sync_status", F.when(F.col("there"), "ok").otherwise("disconnected")).drop("there", "effective")


def upsert_vectors(stored: DataFrame, new: DataFrame, photos: DataFrame) -> DataFrame:
    """photo_id, embedding: new rows of photos that exist replace stored ones."""
    valid = new.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    return stored.join(valid.select("photo_id"), "photo_id", "left_anti").unionByName(valid)
