"""Faces and persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.functions.constants import FACE_NEIGHBOURS, FACE_SIMILARITY
from mediaweave.operators.clusters import with_components
from mediaweave.operators.vectors import mean_vectors, nearest_neighbours
from mediaweave.sources.shared import publish

LEAST_FACE_PX, REDETECT_PX, PADDING = 40, 80, 0.2


def face_gate(faces: DataFrame, width: Column, height: Column) -> DataFrame:
    """Drops faces of under 40 pixels in width or height, and those without a vector."""
    return faces.filter((F.col("bbox_w") * width >= LEAST_FACE_PX) & (F.col("bbox_h") * height >= LEAST_FACE_PX) & F.col("embedding").isNotNull())


def face_redetect(faces: DataFrame, photos: DataFrame, preview_width: int) -> DataFrame:
    """photos: photo_id, exif_width. Photos whose preview is narrower than they are and has a face under 80 pixels."""
    small = faces.groupBy("photo_id").agg(F.bool_or(F.col("bbox_w") * preview_width < REDETECT_PX).alias("small"))
    return photos.join(small, "photo_id").select("photo_id", (F.col("small") & (F.coalesce("exif_width", F.lit(4000)) > preview_width)).alias("redetect"))


def face_counts(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """photos: id. id, face_count (0 where there is none)."""
    n = faces.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("face_count"))
    return photos.select("id").join(n, "id", "left").select("id", F.coalesce("face_count", F.lit(0)).alias("face_count"))


def explode_detections(photos: DataFrame) -> DataFrame:
    """photos: photo_id, width, height, detections: array of (x1, y1, x2, y2, confidence, embedding). One row a face
    that passes the gate, its box as shares of the image."""
    one = photos.select("photo_id", "width", "height", F.posexplode("detections").alias("position", "d"))
    box = S.bbox_normalize(*(F.col(f"d.{c}") for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))
    named = one.select("photo_id", "position", "width", "height", *(c.alias(n) for c, n in zip(box, ("bbox_x", "bbox_y", "bbox_w", "bbox_h"), strict=True)), F.col("d.confidence").alias("confidence"), F.col("d.embedding").alias("embedding"))
    return face_gate(named, F.col("width"), F.col("height")).drop("width", "height")


def face_crop_window(faces: DataFrame, width: Column, height: Column) -> DataFrame:
    """A square around the face with a fifth of padding on each side, in whole pixels within the image."""
    px = {n: (F.col(f"bbox_{n}") * side).cast("int") for n, side in (("x", width), ("y", height), ("w", width), ("h", height))}
    df = faces.select("id", "photo_id", width.cast("int").alias("img_w"), height.cast("int").alias("img_h"), *(c.alias(n) for n, c in px.items()))
    df = df.withColumn("longer", F.greatest("w", "h")).withColumn("side", F.col("longer") + 2 * (F.col("longer") * F.lit(PADDING)).cast("int"))
    df = df.withColumn("x1", F.expr("cast(greatest(0, x + w DIV 2 - side DIV 2) AS INT)")).withColumn("y1", F.expr("cast(greatest(0, y + h DIV 2 - side DIV 2) AS INT)"))
    return df.select("id", "photo_id", "x1", "y1", F.least(F.col("img_w"), F.col("x1") + F.col("side")).alias("x2"), F.least(F.col("img_h"), F.col("y1") + F.col("side")).alias("y2"))


def representatives(faces: DataFrame, key: str = "person_id") -> DataFrame:
    """Of each person the face with the largest confidence times area, ties to the first."""
    score = F.col("confidence") * F.col("bbox_w") * F.col("bbox_h")
    return faces.groupBy(key).agg(F.max_by("id", F.struct(score.alias("s"), (-F.col("id")).alias("first"))).alias("representative_face_id"), F.count("*").alias("face_count"))


def face_persons(faces: DataFrame, k: int = FACE_NEIGHBOURS, least: float = FACE_SIMILARITY) -> DataFrame:
    """faces: id, embedding and the rest. Faces with person_id: the smallest id of their component of the neighbour graph."""
    links = nearest_neighbours(faces, k, least).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    parts = with_components(faces.select("id"), publish(links)).withColumnRenamed("cluster_id", "person_id")
    return faces.drop("person_id").join(parts, "id")


def person_names(members: DataFrame, reps: DataFrame, old_persons: DataFrame) -> DataFrame:
    """members: id, person_id (new); reps: person_id, representative_face_id; old_persons: name, hidden,
    representative_face_id. A person keeps the name, and being hidden, of the old person that its representative stood
    for, else of the first of its faces that stood for a named one."""
    old = old_persons.filter("name IS NOT NULL").select(F.col("representative_face_id").alias("id"), "name", "hidden")
    first = members.join(old, "id").groupBy("person_id").agg(F.min_by(F.struct("name", "hidden"), "id").alias("first"))
    own = reps.select("person_id", F.col("representative_face_id").alias("id")).join(old, "id").select("person_id", F.struct("name", "hidden").alias("own"))
    kept = F.coalesce("own", "first")
    return reps.join(own, "person_id", "left").join(first, "person_id", "left").select("person_id", kept["name"].alias("name"), F.coalesce(kept["hidden"], F.lit(False)).alias("hidden"))


def persons(faces: DataFrame, old_persons: DataFrame, k: int = FACE_NEIGHBOURS, least: float = FACE_SIMILARITY) -> DataFrame:
    """id, name, hidden, face_count, representative_face_id, centroid."""
    members = publish(face_persons(faces, k, least))
    reps = representatives(members)
    names = person_names(members, reps, old_persons)
    centroids = mean_vectors(members, "person_id", epsilon=1e-8).select("person_id", "centroid")
    return reps.join(names, "person_id").join(centroids, "person_id").select(F.col("person_id").alias("id"), "name", "hidden", "face_count", "representative_face_id", "centroid")


def faces_on_photo(faces: DataFrame, persons_: DataFrame) -> DataFrame:
    """Each face of a photo with its person's name."""
    named = persons_.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return faces.join(named, "person_id", "left").select("photo_id", F.col("id").alias("face_id"), "person_id", "person_name", "confidence")


def person_photos(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """The photos of each person, once: person_id, photo_id, exif_date."""
    pairs = faces.filter("person_id IS NOT NULL").select("person_id", "photo_id").distinct()
    return pairs.join(photos.select(F.col("id").alias("photo_id"), "exif_date"), "photo_id")
