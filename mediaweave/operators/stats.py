"""Statistics of the library and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.functions.constants import DEFAULT_SECONDS


def library_stats(photos: DataFrame, clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """One row; the photos are read once."""
    levels = [F.count_if(F.col("processing_level") == n).alias(f"level_{n}") for n in range(4)]
    own = photos.agg(F.count("*").alias("total_photos"), *levels, F.count("user_decision").alias("marked"), F.count_if(F.col("is_technical") == 1).alias("technical"), F.count_if(F.col("sync_status") == "disconnected").alias("disconnected"))
    return own.join(clusters.agg(F.count("*").alias("total_clusters")), F.lit(True)).join(sources.agg(F.count("*").alias("total_sources")), F.lit(True))


def counts_by(photos: DataFrame, column: str) -> DataFrame:
    """How many rows have each value, nulls left out."""
    return photos.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def level_info(photos: DataFrame, target: int = 2) -> DataFrame:
    """Of a selection: the smallest level of what is connected (0 if nothing is), counts, and what is pending below the
    target. No sync status counts as connected."""
    gone = F.coalesce("sync_status", F.lit("ok")) == "disconnected"
    level = F.least(F.col("processing_level"), F.lit(3))
    by_level = [F.count_if(~gone & (level == n)).alias(f"level_{n}") for n in range(4)]
    return photos.agg(F.coalesce(F.min(F.when(~gone, F.col("processing_level"))), F.lit(0)).alias("min_level"), F.count_if(gone).alias("disconnected"), F.count_if(~gone).alias("active"), *by_level, F.count_if(~gone & (level < target)).alias("pending"))


def estimate(runs: DataFrame, n_photos: int, device: str = "cpu", last: int = 5) -> DataFrame:
    """Per stage the seconds that so many photos will take: the mean of the last runs' seconds an item, or a default."""
    recent = runs.filter("items > 0").withColumn("recent", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("created_at"), F.desc("id")))).filter(F.col("recent") <= last)
    rates = recent.groupBy("stage").agg(F.avg(F.try_divide("duration_s", "items")).alias("rate"))
    stages = runs.select("stage").distinct()
    return stages.join(rates, "stage", "left").select("stage", F.coalesce("rate", F.lit(DEFAULT_SECONDS[device])).alias("per_item_s"), F.round(F.coalesce("rate", F.lit(DEFAULT_SECONDS[device])) * n_photos, 1).alias("seconds"))


def stage_rates(runs: DataFrame) -> DataFrame:
    """Items a second of each run; null where either is zero."""
    return runs.withColumn("rate", F.when((F.col("items") > 0) & (F.col("duration_s") > 0), F.col("items") / F.col("duration_s")))


def source_counts(sources: DataFrame, photos: DataFrame) -> DataFrame:
    n = photos.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return sources.join(n, "id", "left").withColumn("photo_count", F.coalesce("n", F.lit(0))).drop("n")


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds timings of stages (or operations) to the log at path."""
    runs.write.mode("append").parquet(path)
