"""The media-library tables, derived from the test tables, in Spark and in SQL. Both use the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.functions.constants import CLASSES
from mediaweave.sources.schemas import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", name)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos_of(table(spark, sf_dir, "events"))


def photos_of(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("string")
    date = F.concat(F.translate(F.substring(ts, 1, 10), "-", ":"), F.substring(ts, 11, 9))
    df = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), "value", date.alias("taken"), F.substring(ts, 1, 10).alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    bits = F.expr("((source_id % 8) * 72340172838076673L) ^ element_at(array(0L, 1L, 3L, 7L), cast(k % 4 AS INT) + 1)")
    df = df.withColumn("hash64", bits)
    name = F.when(F.expr("id % 19 = 0"), F.concat(F.lit("IMG_"), "id")).otherwise(F.concat(F.lit("IMG_"), "id", F.lit(".jpg")))
    df = df.withColumn("original_filename", name)
    return df.select(
        "id", "source_id",
        F.expr("CASE WHEN id % 9 = 0 THEN NULL ELSE source_id * 10 + id % 3 END").alias("cluster_id"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 101 = 0 THEN 'bad date' ELSE taken END").alias("exif_date"),
        F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE 55D + (source_id % 20) * 0.0002D END").alias("exif_gps_lat"),
        F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE 37D + (source_id % 5) * 0.0002D END").alias("exif_gps_lon"),
        F.expr("CASE WHEN id % 97 = 0 THEN NULL ELSE lower(lpad(hex(hash64), 16, '0')) END").alias("perceptual_hash"),
        F.expr("sha2(concat_ws('-', source_id % 8, k % 4, day), 256)").alias("content_hash"),
        (F.col("value") * 10).alias("quality_blur"), F.expr("k * 2.56D").alias("quality_exposure"),
        F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE 1 + k / 11D END").alias("quality_aesthetic"),
        F.expr("cast(id % 4 AS INT)").alias("processing_level"),
        F.when(F.expr("id % 6 = 0"), F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, CLASSES)), F.expr("cast(id % 22 AS INT) + 1"))).alias("content_category"),
        F.expr("cast(id % 22 < 8 AND id % 6 <> 0 AS INT)").alias("is_technical"),
        F.expr("CASE id % 4 WHEN 1 THEN 'keep' WHEN 2 THEN 'delete' WHEN 3 THEN 'archive' END").alias("user_decision"),
        F.expr("CASE WHEN id % 13 = 0 THEN 'disconnected' WHEN id % 17 = 0 THEN NULL ELSE 'ok' END").alias("sync_status"),
        F.expr("CASE WHEN id % 23 = 0 THEN id END").alias("user_cluster_override"),
        F.expr("cast(id % 5 AS INT)").alias("rank_in_cluster"), F.expr("cast(id % 31 = 0 AS INT)").alias("is_exact_duplicate"),
        F.expr("CASE WHEN id % 11 = 0 THEN concat('/moved/', original_filename) WHEN id % 29 = 0 THEN '' END").alias("current_path"),
        F.concat(F.lit("/lib/u"), "source_id", F.lit("/"), "original_filename").alias("original_path"), "original_filename",
    )


PHOTOS = f"""photos AS (
  SELECT id, source_id,
    CASE WHEN id % 9 = 0 THEN NULL ELSE source_id * 10 + id % 3 END AS cluster_id,
    CASE WHEN id % 7 = 0 THEN NULL WHEN id % 101 = 0 THEN 'bad date' ELSE taken END AS exif_date,
    CASE WHEN id % 3 = 0 THEN NULL ELSE 55::DOUBLE + (source_id % 20) * 0.0002::DOUBLE END AS exif_gps_lat,
    CASE WHEN id % 3 = 0 THEN NULL ELSE 37::DOUBLE + (source_id % 5) * 0.0002::DOUBLE END AS exif_gps_lon,
    CASE WHEN id % 97 = 0 THEN NULL ELSE lower(lpad(printf('%x', hash64), 16, '0')) END AS perceptual_hash,
    CASE WHEN id % 97 = 0 THEN NULL ELSE hash64 END AS bits,
    sha256(concat_ws('-', source_id % 8, k % 4, day)) AS content_hash,
    value * 10 AS quality_blur, k * 2.56::DOUBLE AS quality_exposure,
    CASE WHEN id % 5 = 0 THEN NULL ELSE 1 + k / 11::DOUBLE END AS quality_aesthetic,
    (id % 4)::INT AS processing_level,
    CASE WHEN id % 6 = 0 THEN NULL ELSE ([{", ".join(f"'{c}'" for c in CLASSES)}])[id % 22 + 1] END AS content_category,
    (id % 22 < 8 AND id % 6 <> 0)::INT AS is_technical,
    CASE id % 4 WHEN 1 THEN 'keep' WHEN 2 THEN 'delete' WHEN 3 THEN 'archive' END AS user_decision,
    CASE WHEN id % 13 = 0 THEN 'disconnected' WHEN id % 17 = 0 THEN NULL ELSE 'ok' END AS sync_status,
    CASE WHEN id % 23 = 0 THEN id END AS user_cluster_override,
    (id % 5)::INT AS rank_in_cluster, (id % 31 = 0)::INT AS is_exact_duplicate,
    CASE WHEN id % 11 = 0 THEN '/moved/' || original_filename WHEN id % 29 = 0 THEN '' END AS current_path,
    '/lib/u' || source_id || '/' || original_filename AS original_path, original_filename
  FROM (SELECT *, xor((source_id % 8) * 72340172838076673, (CAST([0, 1, 3, 7] AS BIGINT[]))[k % 4 + 1]) AS hash64,
               CASE WHEN id % 19 = 0 THEN 'IMG_' || id ELSE 'IMG_' || id || '.jpg' END AS original_filename
        FROM (SELECT event_id AS id, user_id AS source_id, value, strftime(ts, '%Y:%m:%d %H:%M:%S') AS taken, strftime(ts, '%Y-%m-%d') AS day,
                     regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events)))"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored clusters: those that photos name, and one without photos for each of some of them."""
    found = photos(spark, sf_dir).filter("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("id")).agg(F.min("id").alias("best_photo_id"), F.min("exif_date").alias("avg_timestamp"))
    empty = found.filter("id % 20 = 0").select((-F.col("id") - 1).alias("id"), F.lit(None).cast("long").alias("best_photo_id"), F.lit(None).cast("string").alias("avg_timestamp"))
    kind = F.expr("CASE abs(id) % 5 WHEN 0 THEN 'dup' WHEN 1 THEN 'singleton' ELSE 'content' END")
    return found.unionByName(empty).select("id", F.concat(F.lit("C"), "id").alias("name"), kind.alias("type"), "best_photo_id", "avg_timestamp")


CLUSTERS = """clusters AS (
  SELECT id, 'C' || id AS name, CASE abs(id) % 5 WHEN 0 THEN 'dup' WHEN 1 THEN 'singleton' ELSE 'content' END AS type, best_photo_id, avg_timestamp
  FROM (WITH f AS (SELECT cluster_id AS id, min(id) AS best_photo_id, min(exif_date) AS avg_timestamp FROM photos WHERE cluster_id IS NOT NULL GROUP BY 1)
        SELECT * FROM f UNION ALL SELECT -id - 1, NULL, NULL FROM f WHERE id % 20 = 0))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("found")).filter("id % 4 <> 0")
    return found.select("id", F.concat(F.lit("/lib/u"), "id").alias("path"), F.col("found").alias("photo_count"), F.expr("CASE WHEN id % 5 = 0 THEN 'unavailable' ELSE 'ok' END").alias("status"))


SOURCES = """sources AS (
  SELECT user_id AS id, '/lib/u' || user_id AS path, count(*) AS photo_count, CASE WHEN user_id % 5 = 0 THEN 'unavailable' ELSE 'ok' END AS status
  FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("vec_id DIV 2").alias("photo_id"), F.expr("CASE WHEN vec_id % 7 = 0 THEN NULL ELSE cast(label AS BIGINT) END").alias("person_id"),
        F.expr("(vec_id % 50) / 100D").alias("bbox_x"), F.expr("(vec_id % 40) / 100D").alias("bbox_y"), F.expr("(vec_id % 30 + 1) / 100D").alias("bbox_w"), F.expr("(vec_id % 25 + 1) / 100D").alias("bbox_h"),
        F.expr("0.5D + (vec_id % 50) / 100D").alias("confidence"), "embedding", F.col("label").cast("long").alias("label"),
    )


FACES = """faces AS (
  SELECT vec_id AS id, vec_id // 2 AS photo_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label::BIGINT END AS person_id,
    (vec_id % 50) / 100::DOUBLE AS bbox_x, (vec_id % 40) / 100::DOUBLE AS bbox_y, (vec_id % 30 + 1) / 100::DOUBLE AS bbox_w, (vec_id % 25 + 1) / 100::DOUBLE AS bbox_h,
    0.5::DOUBLE + (vec_id % 50) / 100::DOUBLE AS confidence, embedding::DOUBLE[] AS embedding, label::BIGINT AS label
  FROM embeddings)"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored persons: one a label, and for each label one that no face names."""
    found = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("id")).agg(F.count("*").alias("face_count"), F.min("vec_id").alias("representative_face_id"))
    gone = found.select((F.col("id") + 1000).alias("id"), F.lit(3).cast("long").alias("face_count"), F.lit(-1).cast("long").alias("representative_face_id"))
    return found.unionByName(gone).select("id", F.expr("CASE WHEN id % 2 = 0 THEN concat('P', id) END").alias("name"), "face_count", "representative_face_id", F.expr("id % 10 = 9").alias("hidden"))


PERSONS = """persons AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN 'P' || id END AS name, face_count, representative_face_id, id % 10 = 9 AS hidden
  FROM (WITH f AS (SELECT label::BIGINT AS id, count(*) AS face_count, min(vec_id) AS representative_face_id FROM embeddings GROUP BY 1)
        SELECT * FROM f UNION ALL SELECT id + 1000, 3, -1 FROM f))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo embeddings: photo_id, embedding, is_technical."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), "embedding", F.expr("cast(label < 3 AS INT)").alias("is_technical"), F.col("label").cast("long").alias("label"))


VECTORS = """vectors AS (SELECT vec_id AS photo_id, embedding::DOUBLE[] AS embedding, (label < 3)::INT AS is_technical, label::BIGINT AS label FROM embeddings)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of stages."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_s"), F.get_json_object("props", "$.k").cast("long").alias("items"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))


RUNS = """runs AS (SELECT user_id AS run_id, event_type AS stage, value AS duration_s, regexp_extract(props, '[0-9]+')::BIGINT AS items, ts AS created_at, event_id AS id FROM events)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known places: a supplier's name at coordinates by its key, near the photos and elsewhere."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), "s_nationkey").alias("country"), F.col("s_name").alias("name"), F.concat(F.lit("R"), F.expr("s_suppkey % 11")).alias("admin2"), F.expr("54.9D + (s_suppkey % 37) * 0.007D").alias("lat"), F.expr("36.9D + (s_suppkey % 41) * 0.006D").alias("lon"), F.col("s_suppkey").cast("long").alias("place_id"),
    )


PLACES = """places AS (
  SELECT 'N' || s_nationkey AS country, s_name AS name, 'R' || (s_suppkey % 11) AS admin2, 54.9::DOUBLE + (s_suppkey % 37) * 0.007::DOUBLE AS lat, 36.9::DOUBLE + (s_suppkey % 41) * 0.006::DOUBLE AS lon, s_suppkey::BIGINT AS place_id FROM supplier)"""

SECONDS = "epoch(try_strptime(trim(exif_date), '%Y:%m:%d %H:%M:%S'))::BIGINT"


def with_views(*views: str, sql: str, recursive: bool = False) -> str:
    head = ",\n".join(views)
    return f"WITH {'RECURSIVE ' * recursive}{head}{sql if sql.startswith(',') else chr(10) + sql}"
