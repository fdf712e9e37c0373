"""Changes as functions of tables: each returns the new rows, which the caller publishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.functions.constants import UPDATABLE
from mediaweave.sources.shared import dealt


def apply_updates(df: DataFrame, updates: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Sets the columns of updates (one row a key; null is a value) in the rows that it names."""
    cols = [c for c in updates.columns if c != key]
    if bad := set(cols) - UPDATABLE[table]:
        raise ValueError(f"columns of {table} that can't be updated: {sorted(bad)}")
    named = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in cols), F.lit(True).alias("named"))
    joined = df.join(named, key, "left")
    return joined.select(*(F.when(F.col("named"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns))


def undo_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows: run_id; runs: run_id, failed. The rows without those that a failed run wrote before it failed; rows of no
    run stay."""
    return rows.join(runs.filter("failed").select("run_id").distinct(), "run_id", "left_anti")


def promote_levels(photos: DataFrame, analysed: DataFrame, embedded: DataFrame, faced: DataFrame) -> DataFrame:
    """Levels after the stages whose ids are given: analysed reach 1, embedded ones of these 2, faced ones of these 3."""
    for ids, name in ((analysed, "a"), (embedded, "e"), (faced, "f")):
        photos = photos.join(ids.select("id", F.lit(True).alias(name)).distinct(), "id", "left")
    level = F.col("processing_level")
    one = F.when(F.col("a") & (level < 1), 1).otherwise(level)
    two = F.when(F.col("e") & (one == 1), 2).otherwise(one)
    return photos.withColumn("processing_level", F.when(F.col("f") & (two == 2), 3).otherwise(two)).drop("a", "e", "f")


def apply_quality(photos: DataFrame, measured: DataFrame) -> DataFrame:
    """measured: id, ok, perceptual_hash, quality_blur, quality_exposure, and maybe exif_width and exif_height. A new hash
    replaces the old; sizes only fill gaps; a row that failed has no quality and still reaches level 1."""
    new = measured.select("id", *(F.col(c).alias(f"new_{c}") for c in measured.columns if c != "id"), F.lit(True).alias("named"))
    joined = photos.join(new, "id", "left")
    named = F.coalesce("named", F.lit(False))
    out = {"perceptual_hash": F.coalesce("new_perceptual_hash", "perceptual_hash"), "processing_level": F.when(named, F.greatest("processing_level", F.lit(1))).otherwise(F.col("processing_level"))}
    for c in ("quality_blur", "quality_exposure"):
        out[c] = F.when(named, F.when(F.col("new_ok"), F.col(f"new_{c}"))).otherwise(F.col(c))
    for c in ("exif_width", "exif_height"):
        if c in photos.columns and c in measured.columns:
            out[c] = F.coalesce(c, f"new_{c}")
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in photos.columns))


def remove_source(photos: DataFrame, source: Column, delete_photos: bool = False) -> DataFrame:
    """Photos after some sources went: theirs are detached, or gone with them."""
    if delete_photos:
        return photos.filter(~F.coalesce(source, F.lit(False)))
    return photos.withColumn("source_id", F.when(source, F.lit(None)).otherwise(F.col("source_id")))


def cascade_delete(gone: DataFrame, photos: DataFrame, vectors: DataFrame, faces: DataFrame, clusters: DataFrame, **more: DataFrame) -> dict[str, DataFrame]:
    """gone: id. The tables without these photos and what hangs from them; clusters forget a best photo that went, and go
    if they have no photos left. more: corrections and face_vectors lose their rows, operations forget the photo, persons
    are counted anew."""
    by_photo = gone.select(F.col("id").alias("photo_id"))
    lost = clusters.join(gone.select(F.col("id").alias("best_photo_id"), F.lit(True).alias("lost")), "best_photo_id", "left")
    forgot = lost.withColumn("best_photo_id", F.when(F.col("lost").isNull(), F.col("best_photo_id"))).select(*clusters.columns)
    left, left_faces = photos.join(gone, "id", "left_anti"), faces.join(by_photo, "photo_id", "left_anti")
    out = {"photos": left, "vectors": vectors.join(by_photo, "photo_id", "left_anti"), "faces": left_faces, "clusters": drop_orphan_clusters(forgot, left)}
    if "corrections" in more:
        out["corrections"] = more["corrections"].join(by_photo, "photo_id", "left_anti")
    if "face_vectors" in more:
        out["face_vectors"] = more["face_vectors"].join(left_faces.select(F.col("id").alias("face_id")), "face_id", "left_semi")
    if "operations" in more:
        marked = more["operations"].join(by_photo.withColumn("lost", F.lit(True)), "photo_id", "left")
        out["operations"] = marked.withColumn("photo_id", F.when(F.col("lost").isNull(), F.col("photo_id"))).select(*more["operations"].columns)
    if "persons" in more:
        out["persons"] = refresh_persons(more["persons"], left_faces)
    return out


def named_clusters(photos: DataFrame) -> DataFrame:
    """The ids of clusters that have photos, once each and never copied: no task holds a row a photo."""
    return dealt(photos.select(F.col("cluster_id").alias("id")).filter("id IS NOT NULL").distinct())


def drop_orphan_clusters(clusters: DataFrame, photos: DataFrame) -> DataFrame:
    return clusters.join(named_clusters(photos), "id", "left_semi")


def orphan_clusters(clusters: DataFrame, photos: DataFrame) -> DataFrame:
    return clusters.join(named_clusters(photos), "id", "left_anti")


def refresh_persons(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """Counts anew, drops persons without faces and forgets representatives that are gone."""
    n = faces.filter("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"))
    there = faces.select(F.col("id").alias("representative_face_id"), F.lit(True).alias("there"))
    joined = persons.join(n, "id").join(there, "representative_face_id", "left")
    return joined.withColumn("face_count", F.col("n")).withColumn("representative_face_id", F.when(F.col("there"), F.col("representative_face_id"))).select(*persons.columns)
