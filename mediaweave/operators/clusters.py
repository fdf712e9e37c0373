"""Clusters of photos: exact duplicates, similarity, incremental assignment, merging, ranks and roll-ups.

A cluster's id is the smallest id of its photos, so that it depends on no order of work."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.functions.constants import EARTH_M, GPS_RADIUS_M, MERGE_SIMILARITY, TIME_WINDOW_S
from mediaweave.operators.cells import TILE, UNIT, unit_rows
from mediaweave.operators.components import connected_components
from mediaweave.operators.pairs import CELL_DEGREES, incremental_match, near_buckets, near_cells, own_cell, similarity_edges, time_buckets
from mediaweave.operators.ranking import rank_in_group
from mediaweave.sources.shared import dealt, publish


def exact_dup_groups(photos: DataFrame) -> DataFrame:
    """Rows whose content_hash occurs more than once: content_hash, id, group_size, place in the group by id.
    Counts combine map-side; places come from a sort by ranges, so that a group may be as large as it likes."""
    groups = photos.groupBy("content_hash").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    members = photos.select("content_hash", "id").join(groups, "content_hash")
    return rank_in_group(members, "content_hash", F.col("id").asc())


def dup_clusters_incremental(photos: DataFrame, new_ids: DataFrame) -> DataFrame:
    """photos: id, content_hash, original_filename, cluster_id; new_ids: id. One row a member of a duplicate group that
    has a new member: id, is_exact_duplicate, cluster_id (after), is_new_cluster, cluster_name, best_photo_id.

    A group with a stored member in a cluster joins that of the lowest id; else its new members make a dup cluster,
    which leaves out stored members without a cluster."""
    marked = photos.join(new_ids.select("id", F.lit(True).alias("new")), "id", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    own, first = F.when(~F.col("new") & F.col("cluster_id").isNotNull(), F.col("id")), F.when(F.col("new"), F.col("id"))
    groups = marked.groupBy("content_hash").agg(F.count("*").alias("n"), F.count_if("new").alias("n_new"), F.min_by("cluster_id", own).alias("joined"), F.min(own).alias("stored"), F.min(first).alias("best"), F.min_by("original_filename", first).alias("best_name"))
    groups = groups.filter("n > 1 AND n_new > 0").drop("n", "n_new")
    fresh = F.col("stored").isNull()
    after = F.when(F.col("new"), F.when(fresh, F.col("best")).otherwise(F.col("joined"))).otherwise(F.col("cluster_id"))
    out = marked.join(groups, "content_hash")
    made = fresh & F.col("new")
    return out.select("id", F.lit(1).alias("is_exact_duplicate"), after.alias("cluster_id"), made.alias("is_new_cluster"), F.when(made, F.concat(S.stem(F.col("best_name")), F.lit(" (dup)"))).alias("cluster_name"), F.when(made, F.col("best")).alias("best_photo_id"))


def dup_clusters(photos: DataFrame) -> DataFrame:
    """As if all photos were new and none had a cluster."""
    bare = photos.select("id", "content_hash", "original_filename").withColumn("cluster_id", F.lit(None).cast("long"))
    return dup_clusters_incremental(bare, bare.select("id"))


def with_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """ids: id. Adds cluster_id, the smallest id that the edges (a, b) reach."""
    parts = connected_components(edges, "a", "b")
    return ids.join(dealt(parts.withColumnRenamed("node", "id")), "id", "left").withColumn("cluster_id", F.coalesce("component", "id")).drop("component")


def ranked(photos: DataFrame, score: Column, ties: Column) -> DataFrame:
    """photos: cluster_id, id and what the score needs. cluster_id, id, score, rank_in_cluster. Places come from a sort by
    ranges, so that a cluster may hold any share of the photos; photos without a cluster get no rank."""
    scored = photos.filter("cluster_id IS NOT NULL").select("cluster_id", "id", score.alias("score"))
    return rank_in_group(scored, "cluster_id", F.desc("score"), ties, name="rank_in_cluster")


def rank_l1(photos: DataFrame) -> DataFrame:
    return ranked(photos, S.l1_score(F.col("quality_blur"), F.col("quality_exposure")), F.asc("id"))


def rank_l2(photos: DataFrame) -> DataFrame:
    return ranked(photos, S.l2_score(F.col("quality_aesthetic"), F.col("quality_blur"), F.col("quality_exposure")), F.desc("id"))


def upper_medians(df: DataFrame, group: str, value: str, head: int = 10) -> DataFrame:
    """The upper median of each group's strings: group, value. Equal strings are counted first, map-side; the counts of
    their first characters (of a date, its day) tell which of those hold the median, and only strings that begin so are
    put in order. No task orders all rows of a group."""
    counted = df.filter(F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n")).withColumn("head", F.substring(value, 1, head))
    heads = counted.groupBy(group, "head").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("head")) - F.col("n")
    heads = heads.select(group, "head", "n", before.alias("before"), F.floor(F.sum("n").over(Window.partitionBy(group)) / 2).alias("middle"))
    heads = heads.filter("before <= middle AND middle < before + n").drop("n")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(group).orderBy(value))
    placed = counted.join(heads, [group, "head"]).withColumn("upto", upto)
    return placed.filter("middle < upto AND middle >= upto - n").select(group, value)


def cluster_rollup(photos: DataFrame, keep_zero: bool = False) -> DataFrame:
    """photos: cluster_id, exif_date, exif_gps_lat, exif_gps_lon. Per cluster: photo_count, avg_timestamp (the upper
    median of the date strings), avg_gps_lat, avg_gps_lon. Coordinates of zero count as missing, or with keep_zero only
    means of zero do."""
    dated = photos.filter(F.coalesce("exif_date", F.lit("")) != "")
    medians = upper_medians(dated, "cluster_id", "exif_date").withColumnRenamed("exif_date", "avg_timestamp")

    def mean(c: str) -> Column:
        return F.nullif(F.avg(c), F.lit(0.0)) if keep_zero else F.avg(F.nullif(F.col(c), F.lit(0.0)))

    sums = photos.groupBy("cluster_id").agg(F.count("*").alias("photo_count"), mean("exif_gps_lat").alias("avg_gps_lat"), mean("exif_gps_lon").alias("avg_gps_lon"))
    return sums.join(medians, "cluster_id", "left")


def describe_clusters(photos: DataFrame) -> DataFrame:
    """photos with cluster_id: id, name, type, best_photo_id, photo_count, avg_timestamp, avg_gps_lat, avg_gps_lon."""
    score = S.l1_score(F.col("quality_blur"), F.col("quality_exposure"))
    best = photos.groupBy("cluster_id").agg(F.min_by(F.struct("id", "original_filename"), F.struct(-score, "id")).alias("best"))
    kind = F.when(F.col("photo_count") == 1, "singleton").otherwise("content")
    return cluster_rollup(photos).join(best, "cluster_id").select(
        F.col("cluster_id").alias("id"), S.stem(F.col("best.original_filename")).alias("name"), kind.alias("type"), F.col("best.id").alias("best_photo_id"), "photo_count", "avg_timestamp", "avg_gps_lat", "avg_gps_lon"
    )


def similarity_clusters(photos: DataFrame) -> DataFrame:
    """All photos clustered anew; those that nothing resembles are singletons."""
    return describe_clusters(with_components(photos.drop("cluster_id"), similarity_edges(photos)))


def incremental_clusters(new: DataFrame, old: DataFrame) -> DataFrame:
    """new photos against stored ones (with cluster_id): id, cluster_id, rank_in_cluster, joined. What matches a stored
    photo that has a cluster joins it with rank 99; the rest is clustered among itself."""
    matched = publish(incremental_match(new, old).filter("cluster_id IS NOT NULL").select("id", "cluster_id"))
    rest = new.join(matched, "id", "left_anti")
    fresh = rank_l1(with_components(rest.drop("cluster_id"), similarity_edges(rest)))
    joined = matched.select("id", "cluster_id", F.lit(99).alias("rank_in_cluster"), F.lit(True).alias("joined"))
    return joined.unionByName(fresh.select("id", "cluster_id", "rank_in_cluster", F.lit(False).alias("joined")))


def singletons(photos: DataFrame) -> DataFrame:
    """A cluster of its own for each photo without one."""
    return photos.filter("cluster_id IS NULL").select("id", F.col("id").alias("cluster_id"), S.stem(F.col("original_filename")).alias("name"), F.lit("singleton").alias("type"), F.col("id").alias("best_photo_id"), F.lit(1).cast("long").alias("photo_count"))


def merge_candidates(photos: DataFrame, clusters: DataFrame, vectors: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """Photos that merging may move: analysed (or in the batch), clustered but not as duplicates, no override, with a
    vector."""
    ready = F.col("processing_level") >= 2
    if batch is not None:
        photos = photos.join(batch.select("id", F.lit(True).alias("in_batch")), "id", "left")
        ready |= F.coalesce("in_batch", F.lit(False))
    kinds = clusters.select(F.col("id").alias("cluster_id"), F.col("type").alias("cluster_type"))
    kept = photos.filter(ready & F.col("user_cluster_override").isNull()).join(kinds, "cluster_id").filter("cluster_type <> 'dup'")
    return kept.join(vectors.select(F.col("photo_id").alias("id"), "embedding"), "id").select("id", "cluster_id", S.seconds(S.parse_date(F.col("exif_date"))).alias("secs"), F.col("exif_gps_lat").alias("lat"), F.col("exif_gps_lon").alias("lon"), "embedding")


def agreeing(one: pa.Table, other: pa.Table, least: float, window: int, metres: float) -> pa.Table:
    """one, other: id, secs, lat, lon, embedding, own (the bucket of their time). Pairs that agree, each taken where the first
    one's bucket is the later, or of one bucket by id; at most TILE rows of scores at a time."""
    a, b = unit_rows(one.column("embedding")), unit_rows(other.column("embedding"))
    (id_a, secs_a, own_a), (id_b, secs_b, own_b) = ([x.column(c).to_numpy() for c in ("id", "secs", "own")] for x in (one, other))
    (lat_a, lon_a), (lat_b, lon_b) = ([x.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lat", "lon")] for x in (one, other))
    whole_a, whole_b = (np.asarray(x.column("lat").is_valid()) & np.asarray(x.column("lon").is_valid()) for x in (one, other))
    found = []
    for at in range(0, len(a) if len(b) else 0, TILE):
        scores = a[at : at + TILE] @ b.T
        i, j = np.nonzero((scores >= least) & (np.abs(secs_a[at : at + TILE, None] - secs_b) <= window))
        s, i = scores[i, j], i + at
        half_lat, half_lon = np.radians(lat_b[j] - lat_a[i]) / 2, np.radians(lon_b[j] - lon_a[i]) / 2
        h = np.sin(half_lat) ** 2 + np.cos(np.radians(lat_a[i])) * np.cos(np.radians(lat_b[j])) * np.sin(half_lon) ** 2
        apart = 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0, 1 - h)))
        placed, alike = whole_a[i] & whole_b[j], whole_a[i] == whole_b[j]  # those of one kind are on both sides
        once = ~alike | (own_a[i] > own_b[j]) | ((own_a[i] == own_b[j]) & (id_a[i] < id_b[j]))
        keep = once & (~placed | (apart <= metres))
        found.append((np.minimum(id_a[i], id_b[j])[keep], np.maximum(id_a[i], id_b[j])[keep], s[keep]))
    columns = [np.concatenate([x[c] for x in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(columns, names=["a", "b", "similarity"])


def embedding_pairs(candidates: DataFrame, least: float = MERGE_SIMILARITY, window: int = TIME_WINDOW_S, metres: float = GPS_RADIUS_M, size: int = UNIT) -> DataFrame:
    """Pairs within the window whose vectors agree, and whose places do if both have one: a, b, similarity.

    Photos meet in blocks of a time bucket, and those that both have a place of a time bucket and cell, so that a crowded time
    costs pairs only where it is a crowded place; those without a place meet all of the time. A block's sides are cut into
    parts of about `size` photos, each of which meets each once, in bounded memory; no vector is fetched for a pair."""
    points = candidates.filter("secs IS NOT NULL AND embedding IS NOT NULL").select("id", "secs", "lat", "lon", "embedding", time_buckets(F.col("secs"), window).alias("own"))
    points = publish(points)
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    placed, bare = points.filter(whole), points.filter(~whole)
    cell, block, kept = CELL_DEGREES * metres / GPS_RADIUS_M, ["kind", "bucket", "cell_row", "cell_column"], points.columns
    nowhere = [F.lit(0).cast("long").alias(c) for c in ("cell_row", "cell_column")]
    before = F.explode(F.array(F.col("own") - 1, F.col("own"))).alias("bucket")
    left = near_cells(placed.select(*kept, F.lit(0).alias("kind"), before), "lat", "lon", cell).select(*kept, *block)
    left = left.unionByName(bare.select(*kept, F.lit(1).alias("kind"), before, *nowhere)).unionByName(bare.select(*kept, F.lit(2).alias("kind"), near_buckets(F.col("own")).alias("bucket"), *nowhere))
    right = placed.select(*kept, F.lit(0).alias("kind"), F.col("own").alias("bucket"), *own_cell(F.col("lat"), F.col("lon"), cell))
    right = right.unionByName(bare.select(*kept, F.lit(1).alias("kind"), F.col("own").alias("bucket"), *nowhere)).unionByName(placed.select(*kept, F.lit(2).alias("kind"), F.col("own").alias("bucket"), *nowhere))
    parts = [side.groupBy(*block).agg(F.ceil(F.count("*") / size).cast("int").alias(n)) for side, n in ((left, "p"), (right, "q"))]
    parts = publish(parts[0].join(dealt(parts[1]), block))
    sides = []
    for side, own, other in ((left, "p", "q"), (right, "q", "p")):
        part = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        cut = side.join(dealt(parts), block).select(*block, *kept, part.alias(f"nth_{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"nth_{other}"))
        sides.append(cut.select(*(F.col(c).alias(c) for c in cut.columns)).groupBy(*block, "nth_p", "nth_q"))  # columns of their own
    return sides[0].cogroup(sides[1]).applyInArrow(partial(agreeing, least=least, window=window, metres=metres), "a long, b long, similarity double")


def merge_clusters_by_embedding(photos: DataFrame, clusters: DataFrame, vectors: DataFrame, least: float = MERGE_SIMILARITY, window: int = TIME_WINDOW_S, batch: DataFrame | None = None) -> DataFrame:
    """Clusters that agreeing photos join: cluster_id, merged_into (the smallest id of those that it is joined with)."""
    candidates = publish(merge_candidates(photos, clusters, vectors, batch))
    pairs = embedding_pairs(candidates, least, window)
    for side in ("a", "b"):
        pairs = pairs.join(candidates.select(F.col("id").alias(side), F.col("cluster_id").alias(f"cluster_{side}")), side)
    edges = pairs.filter("cluster_a <> cluster_b").select("cluster_a", "cluster_b").distinct()
    parts = connected_components(edges, "cluster_a", "cluster_b")
    return parts.filter("node <> component").select(F.col("node").alias("cluster_id"), F.col("component").alias("merged_into"))


def apply_merges(photos: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos in their clusters after a merge, and the roll-up of the clusters that took others in."""
    moved = photos.join(merges, "cluster_id", "left").withColumn("cluster_id", F.coalesce("merged_into", "cluster_id")).drop("merged_into")
    grown = moved.join(merges.select(F.col("merged_into").alias("cluster_id")).distinct(), "cluster_id", "left_semi")
    return moved, cluster_rollup(grown, keep_zero=True).withColumn("type", F.lit("content"))


def bursts(photos: DataFrame, gap: int = TIME_WINDOW_S, span: int = 86_400) -> DataFrame:
    """Runs of a source's photos with at most gap seconds between neighbours: source_id, burst, photo_count, first_s,
    last_s. Bursts are numbered within spans of a source's time, whose ends and counts, one row a span, join them across
    spans: no task sees a whole source, and photos of one second are one row."""
    taken = photos.select("source_id", S.seconds(S.parse_date(F.col("exif_date"))).alias("secs")).filter("secs IS NOT NULL")
    moments = taken.groupBy("source_id", "secs").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("secs") / span))
    within, along = Window.partitionBy("source_id", "span").orderBy("secs"), Window.partitionBy("source_id").orderBy("span")
    new = F.coalesce((F.col("secs") - F.lag("secs").over(within) > gap).cast("long"), F.lit(0))
    parts = publish(moments.withColumn("new", new).withColumn("nth", F.sum("new").over(within)).groupBy("source_id", "span", "nth").agg(F.sum("n").alias("n"), F.min("secs").alias("first_s"), F.max("secs").alias("last_s")))
    spans = parts.groupBy("source_id", "span").agg(F.count("*").alias("k"), F.min("first_s").alias("start"), F.max("last_s").alias("end"))
    goes_on = F.coalesce((F.col("start") - F.lag("end").over(along) <= gap).cast("long"), F.lit(0))
    spans = spans.withColumn("fresh", F.col("k") - goes_on).select(F.col("source_id").alias("of"), F.col("span").alias("at"), (F.sum("fresh").over(along) - F.col("k") + 1).alias("first"))
    numbered = parts.join(dealt(spans), F.col("source_id").eqNullSafe(F.col("of")) & (F.col("span") == F.col("at"))).withColumn("burst", F.col("first") + F.col("nth"))
    return numbered.groupBy("source_id", "burst").agg(F.sum("n").alias("photo_count"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))
