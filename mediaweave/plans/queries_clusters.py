"""Queries of pair joins, components, clusters and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.operators import clusters as C
from mediaweave.operators import pairs as P
from mediaweave.operators.components import connected_components
from mediaweave.plans import views as V
from mediaweave.plans.views import with_views

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def points(spark, d):
    return V.photos(spark, d).select("id", S.seconds(S.parse_date(F.col("exif_date"))).alias("secs"), F.col("exif_gps_lat").alias("lat"), F.col("exif_gps_lon").alias("lon"), S.hash_bits(F.col("perceptual_hash")).alias("bits"))


HAVERSINE = "2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h}))"


def metres(a: str, b: str) -> str:
    h = f"(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)"
    return HAVERSINE.format(h=h)


NODES = f"""n AS (
  SELECT id, source_id, cluster_id, exif_date, {V.SECONDS} AS secs, exif_gps_lat AS lat, exif_gps_lon AS lon, bits,
    CASE WHEN coalesce(exif_date, '') <> '' AND exif_gps_lat IS NOT NULL THEN 'AB' WHEN exif_gps_lat IS NOT NULL THEN 'GPS' WHEN coalesce(exif_date, '') <> '' THEN 'DATE' ELSE 'NONE' END AS grp
  FROM photos)"""
#: By group, so that each is a join on what it can be joined on.
PAIRS = f"""timed AS (
  SELECT a.id AS a, b.id AS b FROM (SELECT *, unnest([secs // 180 - 1, secs // 180, secs // 180 + 1]) AS t FROM n WHERE secs IS NOT NULL) a JOIN n b ON b.secs // 180 = a.t AND a.id < b.id AND a.grp = b.grp
  WHERE abs(a.secs - b.secs) <= 180 AND bit_count(xor(a.bits, b.bits)) <= 12 AND (a.grp = 'DATE' OR a.grp = 'AB' AND {metres('a', 'b')} <= 50)),
pairs AS (
  SELECT a, b FROM timed
  UNION ALL SELECT a.id, b.id FROM n a JOIN n b ON a.grp = 'GPS' AND b.grp = 'GPS' AND a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 6 AND {metres('a', 'b')} <= 50
  UNION ALL SELECT a.id, b.id FROM n a JOIN n b ON a.grp = 'NONE' AND b.grp = 'NONE' AND a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 4)"""
CLOSURE = """links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT id, id AS other FROM n UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)"""
L1_SCORE = "0.6 * least(coalesce(nullif(quality_blur, 0), 0) / 500, 1) + 0.4 * greatest(0, 1 - abs(coalesce(nullif(quality_exposure, 0), 128) - 128) / 128)"
L2_SCORE = "coalesce(nullif(quality_aesthetic, 0), 5) - CASE WHEN quality_blur < 500 THEN 2 ELSE 0 END - CASE WHEN quality_exposure < 50 OR quality_exposure > 220 THEN 1 ELSE 0 END"


@query(with_views(V.PHOTOS, NODES, PAIRS, CLOSURE, recursive=True, sql=f"""
, c AS (SELECT p.*, parts.cluster_id AS part, {L1_SCORE} AS score FROM photos p JOIN parts USING (id)),
best AS (SELECT part, id AS best_photo_id, regexp_replace(original_filename, '\\.[^.]*$', '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, id) AS r FROM c) WHERE r = 1),
med AS (SELECT part, exif_date AS avg_timestamp FROM (SELECT part, exif_date, row_number() OVER (PARTITION BY part ORDER BY exif_date) AS place, count(*) OVER (PARTITION BY part) AS n FROM c WHERE coalesce(exif_date, '') <> '') WHERE place = n // 2 + 1)
SELECT c.part AS id, any_value(best.name) AS name, CASE WHEN count(*) = 1 THEN 'singleton' ELSE 'content' END AS type, any_value(best.best_photo_id) AS best_photo_id, count(*) AS photo_count,
  any_value(med.avg_timestamp) AS avg_timestamp, round(avg(nullif(exif_gps_lat, 0)), 6) AS avg_gps_lat, round(avg(nullif(exif_gps_lon, 0)), 6) AS avg_gps_lon
FROM c JOIN best ON best.part = c.part LEFT JOIN med ON med.part = c.part GROUP BY c.part"""))
def similarity_clusters(spark, d):
    return rounded(C.similarity_clusters(V.photos(spark, d)), "avg_gps_lat", "avg_gps_lon")


@query(with_views(V.PHOTOS, NODES, PAIRS, CLOSURE, recursive=True, sql="SELECT parts.id, parts.cluster_id AS component FROM parts"))
def components(spark, d):
    photos = V.photos(spark, d)
    return C.with_components(photos.select("id"), P.similarity_edges(photos)).withColumnRenamed("cluster_id", "component")


@query(with_views(V.PHOTOS, NODES, PAIRS, CLOSURE, recursive=True, sql="SELECT cluster_id AS component, count(*) AS n FROM parts GROUP BY 1 HAVING count(*) > 1"))
def similarity_edges(spark, d):
    """The sizes of what the links join: the links themselves are one of many sets with the same closure."""
    parts = connected_components(P.similarity_edges(V.photos(spark, d)), "a", "b")
    return parts.groupBy("component").agg(F.count("*").alias("n"))


@query(with_views(V.PHOTOS, NODES, sql="SELECT a.id AS a, b.id AS b, abs(a.secs - b.secs) AS gap FROM (SELECT *, unnest([secs // 180 - 1, secs // 180, secs // 180 + 1]) AS t FROM n) a JOIN n b ON b.secs // 180 = a.t AND a.id < b.id AND abs(a.secs - b.secs) <= 180"))
def time_band_pairs(spark, d):
    return P.time_band_pairs(points(spark, d))


@query(with_views(V.PHOTOS, NODES, sql="""
, b AS (SELECT id, secs, sum(fresh) OVER (ORDER BY secs, id) AS band FROM (SELECT id, secs, CASE WHEN secs - lag(secs) OVER (ORDER BY secs, id) <= 180 THEN 0 ELSE 1 END AS fresh FROM n WHERE secs IS NOT NULL))
SELECT id, min(id) OVER (PARTITION BY band) AS band_id, (count(*) OVER (ORDER BY secs RANGE BETWEEN 180 PRECEDING AND 180 FOLLOWING) - 1)::BIGINT AS n_links FROM b"""))
def time_bands(spark, d):
    """The pairs of time_band_pairs as classes: a row a photo, with its number of links."""
    return P.time_bands(points(spark, d))


@query(with_views(V.PHOTOS, NODES, sql=f"""
, c AS (SELECT lat, lon, min(id) AS id, count(*) AS n FROM n WHERE lat IS NOT NULL GROUP BY lat, lon)
SELECT a.id AS a, b.id AS b, round({metres('a', 'b')}, 4) AS metres, a.n * b.n AS links FROM c a JOIN c b ON a.id < b.id AND {metres('a', 'b')} <= 50
UNION ALL SELECT id, id, 0, n * (n - 1) // 2 FROM c WHERE n > 1"""))
def geo_radius_pairs(spark, d):
    """Photos at one spot are one class; pairs of classes, and each class with itself, tell how many links they stand for."""
    heads = P.class_heads(points(spark, d).filter("lat IS NOT NULL"), "lat", "lon")
    return rounded(P.class_links(P.geo_radius_pairs(heads), heads, "metres", 0.0), "metres", digits=4)


@query(with_views(V.PHOTOS, NODES, sql="""
, c AS (SELECT bits, min(id) AS id, count(*) AS n FROM n WHERE bits IS NOT NULL GROUP BY bits)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.bits, b.bits))::INT AS bits_apart, a.n * b.n AS links FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 6
UNION ALL SELECT id, id, 0, n * (n - 1) // 2 FROM c WHERE n > 1"""))
def hamming_pairs(spark, d):
    """Photos with one hash are one class, as in geo_radius_pairs."""
    heads = P.class_heads(points(spark, d).filter("bits IS NOT NULL"), "bits")
    return P.class_links(P.hamming_pairs(heads, 6), heads, "bits_apart", 0)


MATCHES = f""", o AS (SELECT * FROM n WHERE id % 4 <> 0), m AS (
  SELECT a.id, b.id AS match_id, b.cluster_id, bit_count(xor(a.bits, b.bits))::INT AS bits_apart,
    row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.bits, b.bits)), b.exif_date NULLS FIRST, b.id) AS r
  FROM n a JOIN o b ON a.grp = b.grp AND a.id % 4 = 0
    AND bit_count(xor(a.bits, b.bits)) <= CASE a.grp WHEN 'GPS' THEN 6 WHEN 'NONE' THEN 4 ELSE 12 END
    AND (a.grp IN ('GPS', 'NONE') OR a.secs IS NULL OR abs(a.secs - b.secs) <= 180) AND (a.grp IN ('DATE', 'NONE') OR {metres('a', 'b')} <= 50))"""


@query(with_views(V.PHOTOS, NODES, sql=MATCHES + " SELECT id, match_id, bits_apart, cluster_id FROM m WHERE r = 1"))
def incremental_match(spark, d):
    photos = V.photos(spark, d)
    return P.incremental_match(photos.filter("id % 4 = 0"), photos.filter("id % 4 <> 0"))


@query(with_views(V.PHOTOS, NODES, PAIRS.replace("FROM n a", "FROM rest a").replace("JOIN n b", "JOIN rest b").replace("FROM n WHERE secs", "FROM rest WHERE secs").replace("timed AS", MATCHES.lstrip(", ") + ", got AS (SELECT id, cluster_id FROM m WHERE r = 1 AND cluster_id IS NOT NULL), rest AS (SELECT * FROM n WHERE id % 4 = 0 AND id NOT IN (SELECT id FROM got)),\ntimed AS", 1), CLOSURE.replace("FROM n UNION", "FROM rest UNION"), recursive=True, sql=f"""
SELECT id, cluster_id, 99 AS rank_in_cluster, true AS joined FROM got UNION ALL
SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY score DESC, id)::INT, false FROM (SELECT p.id, parts.cluster_id AS part, {L1_SCORE} AS score FROM photos p JOIN parts USING (id))"""))
def incremental_clusters(spark, d):
    photos = V.photos(spark, d)
    return C.incremental_clusters(photos.filter("id % 4 = 0"), photos.filter("id % 4 <> 0"))


@query("SELECT sha256(text) AS content_hash, doc_id AS id, n AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id)::INT AS place FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def exact_dup_groups(spark, d):
    return C.exact_dup_groups(V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash")))


DUPS = """SELECT p.id, 1 AS is_exact_duplicate, CASE WHEN p.fresh AND g.stored IS NULL THEN g.best WHEN p.fresh THEN g.joined ELSE p.cluster_id END AS cluster_id,
  g.stored IS NULL AND p.fresh AS is_new_cluster, CASE WHEN g.stored IS NULL AND p.fresh THEN regexp_replace(g.best_name, '\\.[^.]*$', '') || ' (dup)' END AS cluster_name, CASE WHEN g.stored IS NULL AND p.fresh THEN g.best END AS best_photo_id
FROM p JOIN (SELECT content_hash, arg_min(cluster_id, id) FILTER (NOT fresh AND cluster_id IS NOT NULL) AS joined, min(id) FILTER (NOT fresh AND cluster_id IS NOT NULL) AS stored,
  min(id) FILTER (fresh) AS best, arg_min(original_filename, id) FILTER (fresh) AS best_name FROM p GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (fresh) > 0) g USING (content_hash)"""


@query(with_views(V.PHOTOS, "p AS (SELECT id, content_hash, original_filename, NULL::BIGINT AS cluster_id, true AS fresh FROM photos)", sql=DUPS))
def dup_clusters(spark, d):
    return C.dup_clusters(V.photos(spark, d))


@query(with_views(V.PHOTOS, "p AS (SELECT id, content_hash || (id % 3) AS content_hash, original_filename, CASE WHEN id % 4 <> 0 AND source_id % 3 = 0 THEN cluster_id END AS cluster_id, id % 4 = 0 AS fresh FROM photos)", sql=DUPS))
def dup_clusters_incremental(spark, d):
    photos = V.photos(spark, d).withColumn("content_hash", F.expr("concat(content_hash, id % 3)"))
    photos = photos.withColumn("cluster_id", F.expr("CASE WHEN id % 4 <> 0 AND source_id % 3 = 0 THEN cluster_id END"))
    return C.dup_clusters_incremental(photos, photos.filter("id % 4 = 0").select("id"))


@query(with_views(V.PHOTOS, sql="SELECT id, id AS cluster_id, regexp_replace(original_filename, '\\.[^.]*$', '') AS name, 'singleton' AS type, id AS best_photo_id, 1::BIGINT AS photo_count FROM photos WHERE cluster_id IS NULL"))
def singletons(spark, d):
    return C.singletons(V.photos(spark, d))


@query(with_views(V.PHOTOS, sql=f"SELECT id, cluster_id, round({L1_SCORE}, 6) AS score, row_number() OVER (PARTITION BY cluster_id ORDER BY {L1_SCORE} DESC, id)::INT AS rank_in_cluster FROM photos WHERE cluster_id IS NOT NULL"))
def rank_l1(spark, d):
    return rounded(C.rank_l1(V.photos(spark, d).filter("cluster_id IS NOT NULL")).select("id", "cluster_id", "score", "rank_in_cluster"), "score")


@query(with_views(V.PHOTOS, sql=f"SELECT id, cluster_id, round({L2_SCORE}, 6) AS score, row_number() OVER (PARTITION BY cluster_id ORDER BY {L2_SCORE} DESC, id DESC)::INT AS rank_in_cluster FROM photos WHERE cluster_id IS NOT NULL"))
def rank_l2(spark, d):
    return rounded(C.rank_l2(V.photos(spark, d).filter("cluster_id IS NOT NULL")).select("id", "cluster_id", "score", "rank_in_cluster"), "score")


@query(with_views(V.PHOTOS, sql="""
SELECT p.cluster_id, count(*) AS photo_count, any_value(m.t) AS avg_timestamp, round(avg(nullif(exif_gps_lat, 0)), 6) AS avg_gps_lat, round(avg(nullif(exif_gps_lon, 0)), 6) AS avg_gps_lon
FROM photos p LEFT JOIN (SELECT cluster_id, list_sort(list(exif_date))[count(*) // 2 + 1] AS t FROM photos WHERE exif_date IS NOT NULL GROUP BY 1) m ON m.cluster_id = p.cluster_id
WHERE p.cluster_id IS NOT NULL GROUP BY 1"""))
def cluster_rollup(spark, d):
    return rounded(C.cluster_rollup(V.photos(spark, d).filter("cluster_id IS NOT NULL")), "avg_gps_lat", "avg_gps_lon")


CANDIDATES = """, k AS (SELECT n.id, n.cluster_id, n.secs, n.lat, n.lon, v.embedding FROM n JOIN photos p ON p.id = n.id JOIN clusters c ON c.id = n.cluster_id JOIN vectors v ON v.photo_id = n.id
  WHERE p.processing_level >= 2 AND p.user_cluster_override IS NULL AND c.type <> 'dup'),
e AS (SELECT a.id AS a, b.id AS b, a.cluster_id AS ca, b.cluster_id AS cb, list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM k a JOIN k b ON a.id < b.id AND abs(a.secs - b.secs) <= 36000
  WHERE (a.lat IS NULL OR b.lat IS NULL OR METRES <= 50) AND list_cosine_similarity(a.embedding, b.embedding) >= 0.2)""".replace("METRES", metres("a", "b"))


@query(with_views(V.PHOTOS, V.CLUSTERS, V.VECTORS, NODES, sql=CANDIDATES + " SELECT a, b, round(similarity, 6) AS similarity FROM e"))
def embedding_pairs(spark, d):
    """The test vectors have few close pairs: the window and the least similarity are wide."""
    candidates = C.merge_candidates(V.photos(spark, d), V.clusters(spark, d), V.vectors(spark, d))
    return rounded(C.embedding_pairs(candidates, 0.2, 36_000), "similarity")


@query(with_views(V.PHOTOS, V.CLUSTERS, V.VECTORS, NODES, recursive=True, sql=CANDIDATES + """,
l AS (SELECT ca, cb FROM e WHERE ca <> cb UNION SELECT cb, ca FROM e WHERE ca <> cb), r AS (SELECT ca AS id, ca AS other FROM l UNION SELECT r.id, l.cb FROM r JOIN l ON l.ca = r.other)
SELECT id AS cluster_id, min(other) AS merged_into FROM r GROUP BY id HAVING min(other) < id"""))
def merge_clusters_by_embedding(spark, d):
    return C.merge_clusters_by_embedding(V.photos(spark, d), V.clusters(spark, d), V.vectors(spark, d), 0.2, 36_000)


@query(with_views(V.PHOTOS, NODES, sql="""
SELECT source_id, burst, count(*) AS photo_count, min(secs) AS first_s, max(secs) AS last_s FROM (
  SELECT source_id, secs, sum(fresh) OVER (PARTITION BY source_id ORDER BY secs, id)::BIGINT AS burst FROM (
    SELECT source_id, id, secs, CASE WHEN secs - lag(secs) OVER (PARTITION BY source_id ORDER BY secs, id) <= 180 THEN 0 ELSE 1 END AS fresh FROM n WHERE secs IS NOT NULL)) GROUP BY 1, 2"""))
def bursts(spark, d):
    return C.bursts(V.photos(spark, d))


@query(with_views(V.PHOTOS, NODES, sql="SELECT id, secs FROM n"))
def parse_dates(spark, d):
    return points(spark, d).select("id", "secs")


@query(with_views(V.PHOTOS, NODES, sql="SELECT grp, count(*) AS n, count(bits) AS hashed FROM n GROUP BY grp"))
def photo_group(spark, d):
    photos = V.photos(spark, d).select(S.photo_group(F.col("exif_date"), F.col("exif_gps_lat"), F.col("exif_gps_lon")).alias("grp"), S.hash_bits(F.col("perceptual_hash")).alias("bits"))
    return photos.groupBy("grp").agg(F.count("*").alias("n"), F.count("bits").alias("hashed"))


@query(with_views(V.PHOTOS, "x AS (SELECT id, exif_gps_lat AS lat, exif_gps_lon AS lon FROM photos)", "y AS (SELECT 55.001::DOUBLE AS lat, 37.002::DOUBLE AS lon)", sql=f"SELECT x.id, round({metres('x', 'y')}, 4) AS metres FROM x, y WHERE x.lat IS NOT NULL"))
def haversine(spark, d):
    placed = V.photos(spark, d).filter("exif_gps_lat IS NOT NULL")
    return placed.select("id", F.round(S.haversine(F.col("exif_gps_lat"), F.col("exif_gps_lon"), F.lit(55.001), F.lit(37.002)), 4).alias("metres"))


@query(with_views(V.PHOTOS, sql="SELECT id, bit_count(xor(bits, 506097522914230528::BIGINT))::INT AS bits_apart FROM photos"))
def hamming(spark, d):
    return V.photos(spark, d).select("id", S.hamming(S.hash_bits(F.col("perceptual_hash")), F.lit(506097522914230528)).cast("int").alias("bits_apart"))


@query(with_views(V.PHOTOS, sql=f"SELECT id, round({L1_SCORE}, 6) AS score FROM photos"))
def aesthetic_l1(spark, d):
    return V.photos(spark, d).select("id", F.round(S.l1_score(F.col("quality_blur"), F.col("quality_exposure")), 6).alias("score"))
