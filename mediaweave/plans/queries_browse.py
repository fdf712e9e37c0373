"""Queries of lists, pages, statistics and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.operators import browse as B
from mediaweave.operators import mutate as M
from mediaweave.operators import pages as P
from mediaweave.operators import stats as T
from mediaweave.plans import views as V
from mediaweave.plans.views import with_views
from mediaweave.sources import buckets
from mediaweave.sources.ingest import sync_check as check_paths
from mediaweave.sources.shared import scratch_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def on_photos(sql: str) -> str:
    return with_views(V.PHOTOS, sql=sql)


@query(on_photos("SELECT id, processing_level, content_category, user_decision FROM photos WHERE processing_level >= 1 AND content_category = 'nature' AND user_decision = 'keep'"))
def photo_filter(spark, d):
    return V.photos(spark, d).filter(B.photo_filter(level=1, category="nature", decision="keep")).select("id", "processing_level", "content_category", "user_decision")


@query(on_photos("SELECT id, exif_date, quality_blur FROM photos WHERE processing_level >= 1 ORDER BY exif_date NULLS FIRST, id LIMIT 100 OFFSET 150"))
def photo_page(spark, d):
    return B.photo_page(V.photos(spark, d), limit=100, offset=150, level=1).select("id", "exif_date", "quality_blur")


@query(on_photos("SELECT id, exif_date, quality_blur FROM photos WHERE processing_level >= 1 ORDER BY quality_blur DESC NULLS LAST, id LIMIT 200 OFFSET 500"))
def stored_page(spark, d):
    """A deep page from a stored order, which reads the ranges that hold it."""
    rows = V.photos(spark, d).filter(B.photo_filter(level=1)).select("id", "exif_date", "quality_blur")
    return P.page(P.write_order(rows, scratch_path(spark), "quality_blur", "desc"), limit=200, offset=500)


@query(on_photos("SELECT count(*) AS total FROM photos WHERE processing_level >= 1 AND user_decision IS NULL"))
def photo_count(spark, d):
    return V.photos(spark, d).filter(B.photo_filter(level=1, decision="none", category="")).agg(F.count("*").alias("total"))


@query(on_photos("SELECT id, original_path, processing_level FROM photos WHERE id IN (SELECT event_id FROM events WHERE value > 90)"))
def photos_by_ids(spark, d):
    wanted = V.table(spark, d, "events").filter("value > 90").select(F.col("event_id").alias("id"))
    return V.photos(spark, d).join(wanted, "id", "left_semi").select("id", "original_path", "processing_level")


@query(on_photos("SELECT id, cluster_id FROM photos WHERE processing_level = 2"))
def ids_by_level(spark, d):
    return V.photos(spark, d).filter("processing_level = 2").select("id", "cluster_id")


@query(on_photos("SELECT DISTINCT cluster_id FROM photos WHERE sync_status = 'disconnected' AND cluster_id IS NOT NULL"))
def ids_by_sync(spark, d):
    return V.photos(spark, d).filter("sync_status = 'disconnected' AND cluster_id IS NOT NULL").select("cluster_id").distinct()


@query(on_photos("SELECT id, CASE WHEN processing_level = 2 THEN 3 ELSE 2 END AS stage FROM photos WHERE processing_level < 2 OR processing_level = 2"))
def work_queue(spark, d):
    """What each stage takes next: the second everything below it, the third exactly level 2."""
    level = F.col("processing_level")
    return V.photos(spark, d).filter((level < 2) | (level == 2)).select("id", F.when(level == 2, 3).otherwise(2).alias("stage"))


@query(on_photos("SELECT cluster_id, id, rank_in_cluster, row_number() OVER (PARTITION BY cluster_id ORDER BY rank_in_cluster NULLS FIRST, id)::INT AS place FROM photos WHERE cluster_id IS NOT NULL"))
def cluster_members(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("rank_in_cluster").asc_nulls_first(), "id"))
    return V.photos(spark, d).filter("cluster_id IS NOT NULL").select("cluster_id", "id", "rank_in_cluster", place.alias("place"))


@query(with_views(V.PHOTOS, V.CLUSTERS, sql="SELECT c.id AS cluster_id, coalesce(string_agg(p.id::VARCHAR, ',' ORDER BY p.rank_in_cluster NULLS FIRST, p.id), '') AS ids FROM clusters c LEFT JOIN photos p ON p.cluster_id = c.id GROUP BY c.id"))
def cluster_photo_ids(spark, d):
    found = B.cluster_photo_ids(V.photos(spark, d), V.clusters(spark, d).select(F.col("id").alias("cluster_id")))
    return found.select("cluster_id", F.array_join("ids", ",").alias("ids"))


@query(with_views(V.PHOTOS, V.CLUSTERS, sql="""SELECT cluster_id, chunk, coalesce(string_agg(id::VARCHAR, ',' ORDER BY place), '') AS ids FROM (
  SELECT c.id AS cluster_id, p.id, row_number() OVER (PARTITION BY c.id ORDER BY p.rank_in_cluster NULLS FIRST, p.id) AS place, ((row_number() OVER (PARTITION BY c.id ORDER BY p.rank_in_cluster NULLS FIRST, p.id) - 1) // 50)::INT AS chunk
  FROM clusters c LEFT JOIN photos p ON p.cluster_id = c.id) GROUP BY ALL"""))
def cluster_photo_chunks(spark, d):
    """The same lists, fifty photos a row."""
    found = B.cluster_photo_chunks(V.photos(spark, d), V.clusters(spark, d).select(F.col("id").alias("cluster_id")), 50)
    return found.select("cluster_id", "chunk", F.array_join("ids", ",").alias("ids"))


LISTING = """, g AS (SELECT cluster_id, count(*) AS n, max(is_exact_duplicate) AS dup, min(id) AS first_id, max(id) AS last_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS photo_ids FROM photos WHERE cluster_id IS NOT NULL GROUP BY 1),
l AS (SELECT c.id, c.name, c.type, coalesce(g.n, 0) AS actual_count, coalesce(g.dup, 0) AS has_exact_dup, g.first_id, g.last_id, g.photo_ids, c.best_photo_id, b.original_filename, b.quality_blur, b.quality_exposure, c.avg_timestamp
  FROM clusters c {} JOIN g ON g.cluster_id = c.id LEFT JOIN photos b ON b.id = c.best_photo_id)"""


def listing(spark, d, nonempty=True):
    return B.cluster_listing(V.clusters(spark, d), V.photos(spark, d).filter("cluster_id IS NOT NULL"), nonempty)


@query(with_views(V.PHOTOS, V.CLUSTERS, sql=LISTING.format("") + " SELECT * FROM l"))
def cluster_listing(spark, d):
    return listing(spark, d)


@query(with_views(V.PHOTOS, V.CLUSTERS, sql=LISTING.format("LEFT") + " SELECT id, array_to_string(list_filter([CASE WHEN type = 'dup' OR has_exact_dup = 1 THEN 'dup' END, CASE WHEN quality_blur < 100 THEN 'blur' END, CASE WHEN quality_exposure > 220 THEN 'over' END, CASE WHEN quality_exposure < 50 THEN 'under' END], lambda x: x IS NOT NULL), ',') AS badges FROM l"))
def cluster_badges(spark, d):
    return B.cluster_badges(listing(spark, d, nonempty=False))


@query(with_views(V.PHOTOS, V.CLUSTERS, sql=LISTING.format("LEFT") + " SELECT id, name, avg_timestamp FROM l ORDER BY avg_timestamp NULLS LAST, id"))
def cluster_gallery(spark, d):
    return B.cluster_gallery(listing(spark, d, nonempty=False)).select("id", "name", "avg_timestamp")


@query(with_views(V.PHOTOS, V.CLUSTERS, sql="SELECT count(*) AS n FROM clusters c WHERE EXISTS (SELECT 1 FROM photos p WHERE p.cluster_id = c.id)"))
def cluster_count(spark, d):
    return M.drop_orphan_clusters(V.clusters(spark, d), V.photos(spark, d)).agg(F.count("*").alias("n"))


@query(with_views(V.PHOTOS, V.CLUSTERS, sql="SELECT id, name FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE p.cluster_id = c.id)"))
def orphan_clusters(spark, d):
    return M.orphan_clusters(V.clusters(spark, d), V.photos(spark, d)).select("id", "name")


@query(on_photos("""
SELECT id, r - 1 AS row_index, (r - 1) // 100 AS page, true AS found FROM (SELECT id, row_number() OVER (ORDER BY quality_blur DESC NULLS LAST, id) AS r FROM photos WHERE content_category = 'food') WHERE id % 10 = 0
UNION ALL SELECT id, 0, 0, false FROM photos WHERE id % 10 = 0 AND content_category IS DISTINCT FROM 'food'"""))
def table_position(spark, d):
    photos = V.photos(spark, d)
    return B.table_position(photos, photos.filter("id % 10 = 0").select("id"), "quality_blur", "desc", category="food")


@query(on_photos("""
SELECT id, coalesce(r - 1, 0) AS row_index, coalesce((r - 1) // 100, 0) AS page, r IS NOT NULL AS found FROM (SELECT id FROM photos WHERE id % 10 = 0)
LEFT JOIN (SELECT id, row_number() OVER (ORDER BY exif_date NULLS FIRST, id) AS r FROM photos WHERE processing_level >= 1) USING (id)"""))
def stored_positions(spark, d):
    """Positions in a stored order, found by buckets of ids."""
    photos = V.photos(spark, d)
    order = P.write_order(photos.filter(B.photo_filter(level=1)).select("id", "exif_date"), scratch_path(spark))
    return P.positions(order, photos.filter("id % 10 = 0").select("id"))


@query(with_views(V.PHOTOS, V.CLUSTERS, V.SOURCES, sql="""
SELECT count(*) AS total_photos, count(*) FILTER (processing_level = 0) AS level_0, count(*) FILTER (processing_level = 1) AS level_1, count(*) FILTER (processing_level = 2) AS level_2, count(*) FILTER (processing_level = 3) AS level_3,
  count(user_decision) AS marked, count(*) FILTER (is_technical = 1) AS technical, count(*) FILTER (sync_status = 'disconnected') AS disconnected, (SELECT count(*) FROM clusters) AS total_clusters, (SELECT count(*) FROM sources) AS total_sources FROM photos"""))
def library_stats(spark, d):
    return T.library_stats(V.photos(spark, d), V.clusters(spark, d), V.sources(spark, d))


@query(on_photos("SELECT user_decision, count(*) AS n FROM photos WHERE user_decision IS NOT NULL GROUP BY 1"))
def decision_counts(spark, d):
    return T.counts_by(V.photos(spark, d), "user_decision")


@query(on_photos("SELECT content_category, count(*) AS n FROM photos WHERE content_category IS NOT NULL GROUP BY 1"))
def category_counts(spark, d):
    return T.counts_by(V.photos(spark, d), "content_category")


@query(on_photos("""
SELECT coalesce(min(processing_level) FILTER (ok), 0) AS min_level, count(*) FILTER (NOT ok) AS disconnected, count(*) FILTER (ok) AS active,
  count(*) FILTER (ok AND processing_level = 0) AS level_0, count(*) FILTER (ok AND processing_level = 1) AS level_1, count(*) FILTER (ok AND processing_level = 2) AS level_2, count(*) FILTER (ok AND processing_level >= 3) AS level_3, count(*) FILTER (ok AND processing_level < 2) AS pending
FROM (SELECT *, coalesce(sync_status, 'ok') <> 'disconnected' AS ok FROM photos WHERE source_id % 2 = 0)"""))
def level_info(spark, d):
    return T.level_info(V.photos(spark, d).filter("source_id % 2 = 0"))


@query(with_views(V.RUNS, sql="""
SELECT s.stage, round(coalesce(r.rate, 0.2), 6) AS per_item_s, round(coalesce(r.rate, 0.2) * 1000, 1) AS seconds FROM (SELECT DISTINCT stage FROM runs) s
LEFT JOIN (SELECT stage, avg(duration_s / items) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY created_at DESC, id DESC) AS r FROM runs WHERE items > 0) WHERE r <= 5 GROUP BY 1) r USING (stage)"""))
def estimate(spark, d):
    return T.estimate(V.runs(spark, d), 1000).withColumn("per_item_s", F.round("per_item_s", 6))


@query(with_views(V.RUNS, sql="SELECT id, stage, CASE WHEN items > 0 AND duration_s > 0 THEN round(items / duration_s, 6) END AS rate FROM runs"))
def stage_rates(spark, d):
    return T.stage_rates(V.runs(spark, d)).select("id", "stage", F.round("rate", 6).alias("rate"))


@query(with_views(V.PHOTOS, V.SOURCES, sql="SELECT s.id, s.path, coalesce(p.n, 0) AS photo_count, s.status FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM photos WHERE id % 3 = 0 GROUP BY 1) p ON p.source_id = s.id"))
def source_counts(spark, d):
    return T.source_counts(V.sources(spark, d), V.photos(spark, d).filter("id % 3 = 0"))


@query(with_views(V.PHOTOS, sql="SELECT id, coalesce(nullif(current_path, ''), original_path) AS path FROM photos"))
def effective_path(spark, d):
    return V.photos(spark, d).select("id", S.effective_path(F.col("current_path"), F.col("original_path")).alias("path"))


@query(with_views(V.PHOTOS, sql="SELECT id, CASE WHEN id % 8 = 0 THEN md5(original_path) ELSE substr(content_hash, 1, 32) END AS asset FROM photos"))
def asset_key(spark, d):
    photos = V.photos(spark, d)
    known = F.expr("CASE WHEN id % 16 = 0 THEN NULL WHEN id % 8 = 0 THEN '' ELSE content_hash END")
    return photos.select("id", S.asset_key(known, F.col("original_path")).alias("asset"))


@query(with_views(V.PHOTOS, sql="SELECT id, CASE WHEN id % 11 <> 0 AND id % 3 <> 0 THEN 'ok' ELSE 'disconnected' END AS sync_status FROM photos"))
def sync_check(spark, d):
    photos = V.photos(spark, d)
    there = photos.filter("id % 3 <> 0").select(F.col("original_path").alias("path"))
    return check_paths(photos, there).select("id", "sync_status")


@query(on_photos("SELECT id FROM photos WHERE processing_level < 2 UNION SELECT id FROM photos WHERE processing_level = 1 OR id % 12 = 6"))
def pending_ids(spark, d):
    photos = V.photos(spark, d)
    before = photos.withColumn("processing_level", F.expr("CASE WHEN id % 12 = 6 THEN 1 ELSE processing_level END"))
    return B.pending_ids(photos, before)


@query(with_views(V.PHOTOS, "l AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'keep' END AS decision FROM labels)", sql="SELECT p.id, CASE WHEN l.id IS NOT NULL THEN l.decision ELSE p.user_decision END AS user_decision FROM photos p LEFT JOIN l USING (id)"))
def apply_decisions(spark, d):
    """Labels as decisions: toxic goes, good stays, and the rest is cleared."""
    made = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "keep").alias("user_decision"))
    return M.apply_updates(V.photos(spark, d), made, "photos").select("id", "user_decision")


@query(on_photos("SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE cluster_id END AS cluster_id, CASE WHEN id % 5 = 0 THEN 1 ELSE rank_in_cluster END AS rank_in_cluster FROM photos"))
def apply_updates(spark, d):
    photos = V.photos(spark, d)
    updates = photos.filter("id % 5 = 0").select("id", F.lit(None).cast("long").alias("cluster_id"), F.lit(1).alias("rank_in_cluster"))
    return M.apply_updates(photos, updates, "photos").select("id", "cluster_id", "rank_in_cluster")


@query(on_photos("""
SELECT id, CASE WHEN one_or_two = 2 AND id % 5 = 0 THEN 3 ELSE one_or_two END AS processing_level FROM (
  SELECT id, CASE WHEN one = 1 AND id % 2 = 0 THEN 2 ELSE one END AS one_or_two FROM (SELECT id, CASE WHEN processing_level < 1 AND id % 3 = 0 THEN 1 ELSE processing_level END AS one FROM photos))"""))
def promote_levels(spark, d):
    photos = V.photos(spark, d)
    return M.promote_levels(photos, *(photos.filter(f"id % {n} = 0") for n in (3, 2, 5))).select("id", "processing_level")


@query(on_photos("""
SELECT id, CASE WHEN id % 4 = 0 AND id % 12 <> 0 THEN '00000000000000ff' ELSE perceptual_hash END AS perceptual_hash, CASE WHEN id % 8 = 0 THEN NULL WHEN id % 4 = 0 THEN 1.5 ELSE round(quality_blur, 6) END AS quality_blur, CASE WHEN id % 4 = 0 THEN greatest(processing_level, 1) ELSE processing_level END AS processing_level FROM photos"""))
def apply_quality(spark, d):
    photos = V.photos(spark, d)
    measured = photos.filter("id % 4 = 0").select("id", F.expr("id % 8 <> 0").alias("ok"), F.expr("CASE WHEN id % 12 <> 0 THEN '00000000000000ff' END").alias("perceptual_hash"), F.lit(1.5).alias("quality_blur"), F.lit(100.0).alias("quality_exposure"))
    return M.apply_quality(photos, measured).select("id", "perceptual_hash", F.round("quality_blur", 6).alias("quality_blur"), "processing_level")


@query(with_views(V.PHOTOS, "l AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'keep' END AS decision FROM labels)", sql="""
SELECT p.id, CASE WHEN l.id IS NOT NULL THEN l.decision ELSE p.user_decision END AS user_decision, CASE WHEN p.id % 8 = 0 THEN NULL WHEN p.id % 4 = 0 THEN 1.5 ELSE round(p.quality_blur, 6) END AS quality_blur,
  CASE WHEN p.id % 4 = 0 THEN greatest(processing_level, 1) ELSE processing_level END AS processing_level FROM photos p LEFT JOIN l USING (id) WHERE p.id % 7 <> 0"""))
def stored_changes(spark, d):
    """Photos in buckets: decisions from labels, measured qualities and deleted photos, each a change of the buckets that it
    names and a version of its own."""
    path, photos = scratch_path(spark), V.photos(spark, d)
    buckets.create(photos, path, "id", 8)
    made = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "keep").alias("user_decision"))
    measured = photos.filter("id % 4 = 0").select("id", F.expr("id % 8 <> 0").alias("ok"), F.lit(None).cast("string").alias("perceptual_hash"), F.lit(1.5).alias("quality_blur"), F.lit(100.0).alias("quality_exposure"))
    buckets.change(spark, path, made, lambda rows, new: M.apply_updates(rows, new, "photos"))
    buckets.change(spark, path, measured, M.apply_quality)
    buckets.change(spark, path, photos.filter("id % 7 = 0").select("id"), lambda rows, keys: buckets.delete_keys(rows, keys, "id"))
    buckets.remove_old(spark, path)
    return buckets.read(spark, path).select("id", "user_decision", F.round("quality_blur", 6).alias("quality_blur"), "processing_level")


@query(on_photos("SELECT id, CASE WHEN source_id % 10 = 3 THEN NULL ELSE source_id END AS source_id FROM photos"))
def remove_source(spark, d):
    return M.remove_source(V.photos(spark, d), F.expr("source_id % 10 = 3")).select("id", "source_id")


@query(with_views(V.PHOTOS, V.CLUSTERS, V.VECTORS, V.FACES, sql="""
SELECT 'photos' AS name, count(*) AS n, sum(id)::BIGINT AS checksum FROM photos WHERE id % 3 <> 0 UNION ALL SELECT 'vectors', count(*), sum(photo_id)::BIGINT FROM vectors WHERE photo_id % 3 <> 0 UNION ALL SELECT 'faces', count(*), sum(id)::BIGINT FROM faces WHERE photo_id % 3 <> 0
UNION ALL SELECT 'clusters', count(*), sum(CASE WHEN best_photo_id % 3 <> 0 THEN best_photo_id END)::BIGINT FROM clusters c WHERE EXISTS (SELECT 1 FROM photos p WHERE p.cluster_id = c.id AND p.id % 3 <> 0)"""))
def cascade_delete(spark, d):
    """What is left of each table."""
    photos = V.photos(spark, d)
    left = M.cascade_delete(V.table(spark, d, "events").filter("event_id % 3 = 0").select(F.col("event_id").alias("id")).unionByName(V.table(spark, d, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))).distinct(), photos, V.vectors(spark, d), V.faces(spark, d), V.clusters(spark, d))
    ids = {"photos": "id", "vectors": "photo_id", "faces": "id", "clusters": "best_photo_id"}
    parts = [left[name].agg(F.count("*").alias("n"), F.sum(c).alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum") for name, c in ids.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
