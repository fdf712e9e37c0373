"""Queries of ingest, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.functions.constants import PHOTO_EXTENSIONS
from mediaweave.operators.mutate import undo_runs
from mediaweave.operators.pairs import similarity_edges
from mediaweave.operators.ranking import global_rank
from mediaweave.plans import views as V
from mediaweave.plans.queries_clusters import CLOSURE, NODES, PAIRS
from mediaweave.plans.views import with_views
from mediaweave.sources import buckets
from mediaweave.sources import ingest as I
from mediaweave.sources.schemas import read_table
from mediaweave.sources.shared import scratch_path, staged
from mediaweave.streaming import ingest as stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LISTED = "CASE WHEN id % 5 = 0 THEN upper(original_path) WHEN id % 7 = 0 THEN original_path || '.txt' ELSE original_path END"


@query(with_views(V.PHOTOS, sql=f"SELECT id, path FROM (SELECT id, {LISTED} AS path FROM photos) WHERE regexp_matches(lower(path), '\\.({'|'.join(x[1:] for x in PHOTO_EXTENSIONS)})$')"))
def file_listing(spark, d):
    """The photos' paths, some in upper case and some of other files: what a listing of their folders keeps. The same
    filter lists folders (sources.ingest.file_listing)."""
    return I.with_extension(V.photos(spark, d).select("id", F.expr(LISTED).alias("path")))


WRITTEN = ("JPG", "png", "txt", "md5")


@query(with_views(V.PHOTOS, sql="SELECT source_id % 20 AS folder, CASE id % 4 WHEN 0 THEN 'JPG' ELSE 'png' END AS extension, 1::BIGINT AS files FROM photos WHERE id % 4 < 2 GROUP BY ALL"))
def folder_listing(spark, d):
    """Folders in folders, written from the photos: a file for each source's folder and kind. The listing goes through all
    of them and keeps files of photos, in whatever case their names end."""
    root, photos = scratch_path(spark), V.photos(spark, d).select("id", F.expr("source_id % 20").alias("folder"), "original_path")
    for kind, extension in enumerate(WRITTEN):
        photos.filter(f"id % 4 = {kind}").drop("id").repartition("folder").write.partitionBy("folder").option("extension", extension).csv(f"{root}/deep/{extension.lower()}")
    found = I.file_listing(spark, root).select(F.regexp_extract("path", r"folder=(\d+)/", 1).cast("long").alias("folder"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("extension"))
    return found.groupBy("folder", "extension").agg(F.count("*").alias("files"))


@query(with_views(V.VECTORS, sql="SELECT photo_id, photo_id % 4 AS run_id FROM vectors WHERE photo_id % 4 <> 3"))
def undo_run(spark, d):
    """Embeddings of four runs, of which one failed half way."""
    rows = V.vectors(spark, d).select("photo_id", F.expr("photo_id % 4").alias("run_id"))
    return undo_runs(rows, rows.select("run_id", F.expr("run_id = 3").alias("failed")).distinct()).select("photo_id", "run_id")


@query(with_views(V.PHOTOS, sql="SELECT id, exif_date, row_number() OVER (ORDER BY exif_date NULLS FIRST, id) - 1 AS place FROM photos"))
def photos_in_order(spark, d):
    """The whole table, written and read back by its stated schema, in order of (exif_date, id), with each row's place."""
    path = scratch_path(spark)
    staged(spark, path, lambda stage: V.photos(spark, d).write.parquet(stage))
    photos = read_table(spark, path, "photos")
    return global_rank(photos.select("id", "exif_date"), F.col("exif_date").asc_nulls_first(), F.col("id").asc(), name="place")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def arriving_documents(df):
    return df.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("/"), "source").alias("original_path"))


INCOMING = "i AS (SELECT doc_id AS id, sha256(text) AS content_hash, '/' || source AS original_path FROM documents), s AS (SELECT * FROM i WHERE id % 5 = 0)"


@query(with_views(INCOMING, sql="SELECT min(id) AS id, content_hash, original_path FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.content_hash = i.content_hash AND s.original_path = i.original_path) GROUP BY ALL"))
def ingest_new(spark, d):
    """All documents against a store that has each fifth."""
    incoming = arriving_documents(V.table(spark, d, "documents"))
    return I.new_rows(incoming, incoming.filter("id % 5 = 0")).select("id", "content_hash", "original_path")


@query(with_views(INCOMING, sql="SELECT sum(n)::BIGINT AS scanned, count(*) FILTER (NOT known) AS new, (sum(n) - count(*) FILTER (NOT known))::BIGINT AS skipped FROM (SELECT i.content_hash, i.original_path, count(DISTINCT i.id) AS n, bool_or(s.id IS NOT NULL) AS known FROM i LEFT JOIN s ON s.content_hash = i.content_hash AND s.original_path = i.original_path GROUP BY ALL)"))
def ingest_report(spark, d):
    incoming = arriving_documents(V.table(spark, d, "documents"))
    return I.ingest_report(incoming, incoming.filter("id % 5 = 0"))


@query(with_views(V.SOURCES, sql="SELECT DISTINCT path, 'u' || id AS name FROM (SELECT id, path FROM sources UNION ALL SELECT user_id, '/lib/u' || user_id FROM events)"))
def source_registry(spark, d):
    paths = V.photos(spark, d).select(F.concat(F.lit("/lib/u"), "source_id").alias("path"))
    return I.register_sources(V.sources(spark, d), paths)


@query("SELECT page_id, url, regexp_matches(url, '^https?://[^/]*\\.example\\.(com|org)(/|$)') AS accepted FROM pages")
def paths_in_sources(spark, d):
    """Addresses under registered hosts."""
    pages = V.table(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    hosts = pages.select(F.regexp_extract("path", "^https?://[^/]*", 0).alias("path")).filter(F.col("path").rlike(r"\.example\.(com|org)$")).distinct()
    return I.within_sources(pages, hosts).select("page_id", "url", "accepted")


UPSERTED = with_views(V.VECTORS, sql="SELECT photo_id, round(CASE WHEN photo_id % 3 = 0 AND photo_id IN (SELECT event_id FROM events) THEN 2 ELSE 1 END * embedding[1], 6) AS first FROM vectors WHERE photo_id % 2 = 0 OR photo_id % 3 = 0 AND photo_id IN (SELECT event_id FROM events)")


@query(UPSERTED)
def upsert_embeddings(spark, d):
    """Even vectors are stored; each third comes again, doubled."""
    vectors = V.vectors(spark, d).select("photo_id", F.expr("transform(embedding, x -> cast(x AS DOUBLE))").alias("embedding"))
    new = vectors.filter("photo_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: 2 * x))
    known = V.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return I.upsert_vectors(vectors.filter("photo_id % 2 = 0"), new, known).select("photo_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query(UPSERTED)
def stored_embeddings(spark, d):
    """The same in buckets of a stored table, of which the upsert writes those that new rows name."""
    path, vectors = scratch_path(spark), V.vectors(spark, d).select("photo_id", F.expr("transform(embedding, x -> cast(x AS DOUBLE))").alias("embedding"))
    buckets.create(vectors.filter("photo_id % 2 = 0"), path, "photo_id", 8)
    new = vectors.filter("photo_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: 2 * x))
    known = V.table(spark, d, "events").select(F.col("event_id").alias("id"))
    buckets.change(spark, path, new, lambda rows, new: I.upsert_vectors(rows, new, known))
    return buckets.read(spark, path).select("photo_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') WHEN event_id % 14 <> 0 THEN '2020:01:02 03:04:05' END AS exif_date, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'Model ' || user_id ELSE event_type || ' Model ' || user_id END AS exif_camera,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 8)::INT END AS exif_orientation, CASE WHEN event_id % 4 <> 0 THEN 4000 END AS exif_width, NULL::INT AS exif_height FROM events""")
def normalize_tags(spark, d):
    """Metadata tags made of events' columns."""
    ts = F.col("ts").cast("string")
    date = F.concat(F.translate(F.substring(ts, 1, 10), "-", ":"), F.substring(ts, 11, 9))
    tags = F.map_filter(
        F.create_map(
            F.lit("EXIF DateTimeOriginal"), F.when(F.expr("event_id % 7 <> 0"), date), F.lit("Image DateTime"), F.when(F.expr("event_id % 14 <> 0"), F.lit("2020:01:02 03:04:05")),
            F.lit("Image Make"), F.when(F.expr("user_id % 3 = 2"), F.col("event_type")), F.lit("Image Model"), F.when(F.expr("user_id % 3 <> 0"), F.concat(F.lit("Model "), "user_id")),
            F.lit("Image Orientation"), F.when(F.expr("event_id % 5 <> 0"), F.concat(F.expr("event_id % 8"), F.lit(" (Normal)"))).otherwise("Rotated"),
            F.lit("EXIF ExifImageWidth"), F.when(F.expr("event_id % 4 <> 0"), "4000").otherwise("wide"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), *(c.alias(n) for n, c in S.normalize_tags(tags).items()))


@query("SELECT event_id AS id, round(CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (user_id % 90 + (event_id % 60) / 60::DOUBLE + (event_id % 6000) / 100::DOUBLE / 3600), 8) AS degrees FROM events")
def dms_to_decimal(spark, d):
    part = lambda num, den: F.struct(F.expr(num).cast("double").alias("num"), F.expr(den).cast("double").alias("den"))
    value = S.dms_to_decimal(part("user_id % 90", "1"), part("event_id % 60", "CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END"), part("event_id % 6000", "100"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'N' END"))
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(value, 8).alias("degrees"))


def arriving(spark, rows, name="id", files=5):
    """A table's rows in several files, of which a stream takes one a batch."""
    folder = scratch_path(spark)
    rows.repartition(files, name).write.parquet(folder)
    return stream.arriving_files(spark, folder, rows.schema)


@query(with_views(INCOMING, sql="SELECT content_hash, original_path, count(DISTINCT content_hash) AS n FROM i GROUP BY ALL"))
def stream_ingest(spark, d):
    """Documents as they arrive in five batches, each content and path once. The stream is stopped after the first files and
    goes on from its checkpoint, with its state, when the others are there. A batch has as many files as Spark makes
    partitions of the table, so that they don't grow with it."""
    documents, folder, path = V.table(spark, d, "documents"), scratch_path(spark), scratch_path(spark)
    files = documents.rdd.getNumPartitions()
    for batches, part in ((2, "doc_id % 3 = 1"), (3, "doc_id % 3 <> 1")):
        documents.filter(part).repartition(batches * files, "doc_id").write.mode("append").parquet(folder)
        stored = stream.stream_ingest(stream.arriving_files(spark, folder, documents.schema, files), arriving_documents, path)
    return stored.groupBy("content_hash", "original_path").agg(F.count("*").alias("n"))


@query(with_views(V.PHOTOS, NODES, PAIRS, CLOSURE, recursive=True, sql="SELECT id, cluster_id FROM parts"))
def stream_clusters(spark, d):
    """Photos as they arrive, all in one batch; later batches match what is stored, so that clusters follow the order."""
    return stream.stream_clusters(arriving(spark, V.table(spark, d, "events"), "event_id", 1), V.photos_of, scratch_path(spark)).select("id", "cluster_id")


@query(with_views(V.PHOTOS, NODES, PAIRS, CLOSURE, recursive=True, sql="SELECT id AS node, cluster_id AS component FROM parts JOIN (SELECT cluster_id FROM parts GROUP BY 1 HAVING count(*) > 1) USING (cluster_id)"))
def stream_components(spark, d):
    """The links between similar photos as they arrive, in five batches of mixed order: the components of one run."""
    links = similarity_edges(V.photos(spark, d)).select("a", "b")
    return stream.stream_components(arriving(spark, links, "b"), scratch_path(spark))[0]
