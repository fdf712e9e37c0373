"""The tables' schemas, stated once; readers never infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of the library's tables.
LIBRARY = {
    "photos": "id long, source_id long, cluster_id long, exif_date string, exif_gps_lat double, exif_gps_lon double, perceptual_hash string, content_hash string, quality_blur double, quality_exposure double, quality_aesthetic double, processing_level int, content_category string, is_technical int, user_decision string, sync_status string, user_cluster_override long, rank_in_cluster int, is_exact_duplicate int, current_path string, original_path string, original_filename string",
    "clusters": "id long, name string, type string, best_photo_id long, photo_count long, avg_timestamp string, avg_gps_lat double, avg_gps_lon double",
    "photo_embeddings": "photo_id long, embedding array<float>, run_id long",
    "faces": "id long, photo_id long, person_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double, embedding array<float>",
    "persons": "id long, name string, face_count long, representative_face_id long, hidden boolean",
    "sources": "id long, path string, name string, photo_count long, status string",
    "runs": "id long, run_id long, stage string, duration_s double, items long, created_at timestamp_ntz",
}
# The columns of the test tables that the library's are derived from.
GIVEN = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "labels": "doc_id long, quality int, toxic int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL((LIBRARY | GIVEN)[name])


def read_table(spark: SparkSession, path: str, name: str, partial: bool = False) -> DataFrame:
    """A table by its stated schema; columns besides aren't read, and one that the files lack is an error, or nulls if the
    table may be partial."""
    schema = schema_of(name)
    lacking = set() if partial else set(schema.names) - set(spark.read.parquet(path).columns)
    if lacking:
        raise ValueError(f"{name} at {path} has no column {', '.join(sorted(lacking))}")
    return spark.read.schema(schema).parquet(path)


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """All photos in order of (exif_date, id), those without a date first. Columns that the table was written without are null."""
    return read_table(spark, path, "photos", partial=True).orderBy(F.col("exif_date").asc_nulls_first(), "id")
