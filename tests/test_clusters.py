from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.operators import clusters as C
from mediaweave.operators import pairs as P
from mediaweave.operators.components import connected_components, extend_components
from mediaweave.sources.shared import published_since

PHOTO = "id long, exif_date string, exif_gps_lat double, exif_gps_lon double, perceptual_hash string, original_filename string, quality_blur double, quality_exposure double"
ZERO, FAR = "0" * 16, "f" * 16


def photo(id_, date=None, place=None, hash_=ZERO, name=None):
    lat, lon = place or (None, None)
    return id_, date, lat, lon, hash_, name or f"p{id_}.jpg", 200.0, 128.0


def at(minute, second=0):
    return f"2024:06:01 12:{minute:02d}:{second:02d}"


HERE = (55.75, 37.61)
CASES = {
    "groups don't cross": ([photo(1, at(0), HERE), photo(2, None, HERE), photo(3, at(0)), photo(4)], 4),
    "300 s apart": ([photo(1, at(0), HERE), photo(2, at(5), HERE)], 2),
    "180 s apart": ([photo(1, at(0), HERE), photo(2, at(3), HERE)], 1),
    "181 s apart": ([photo(1, at(0), HERE), photo(2, at(3, 1), HERE)], 2),
    "far hash": ([photo(1, at(0), HERE, "aaa0" + "0" * 12), photo(2, at(2), HERE, FAR)], 2),
    "30 bits": ([photo(1, at(0), HERE), photo(2, at(0, 30), HERE, f"{2**30 - 1:016x}")], 2),
    "10 bits": ([photo(1, at(0), HERE), photo(2, at(0, 30), HERE, f"{0x3FF:016x}")], 1),
    "no date, no place: 4 bits": ([photo(1, hash_="aaa0" + "0" * 12), photo(2, hash_="aaa1" + "0" * 12), photo(3, hash_=FAR)], 2),
    "date only": ([photo(1, at(0)), photo(2, at(1))], 1),
    "place only": ([photo(1, None, HERE), photo(2, None, HERE)], 1),
    "over 50 m": ([photo(1, None, HERE), photo(2, None, (55.7506, 37.61))], 2),
    "no hash": ([photo(1, at(0), hash_=None), photo(2, at(0), hash_=None)], 2),
    "date that isn't one": ([photo(1, "bad"), photo(2, "bad")], 2),
    "none": ([], 0),
}


@pytest.mark.parametrize("case", CASES)
def test_similarity(spark, case):
    rows, n = CASES[case]
    assert C.similarity_clusters(spark.createDataFrame(rows, PHOTO)).count() == n


def test_dates(spark):
    df = spark.createDataFrame([("2024:01:05 01:02:03",), (" 2024:1:5 1:2:3 ",), ("2024:13:01 00:00:00",), ("bad",), ("",), (None,)], "d string")
    got = [r[0] for r in df.select(S.seconds(S.parse_date(F.col("d")))).collect()]
    assert got == [1704416523, 1704416523, None, None, None, None]


def test_hash_bits(spark):
    df = spark.createDataFrame([("ffffffffffffffff",), ("aaa0000000000000",), ("zz",), (None,)], "h string")
    assert [r[0] for r in df.select(S.hash_bits(F.col("h"))).collect()] == [-1, 0xAAA0000000000000 - 2**64, None, None]


def test_radius_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([89.95, -60.0, 0.0, 55.0]) + rng.uniform(-0.002, 0.002), rng.choice([179.9995, -179.9995, 10.0]) + rng.uniform(-0.002, 0.002)) for i in range(400)]
    points = [(i, max(-90.0, min(90.0, a)), b) for i, a, b in points]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    a, b = (df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns)) for s in "ab")
    metres = S.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    want = {(r[0], r[1]) for r in a.join(b, F.col("id_a") < F.col("id_b")).filter(metres <= 50).select("id_a", "id_b").collect()}
    got = [(r.a, r.b) for r in P.geo_radius_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_hamming_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for h in base for _ in range(12)]
    signed = [h - 2**64 if h >> 63 else h for h in hashes]
    for radius in (4, 6, 12):
        want = {(i, j) for i, j in itertools.combinations(range(len(hashes)), 2) if bin(hashes[i] ^ hashes[j]).count("1") <= radius}
        got = [(r.a, r.b) for r in P.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, bits long"), radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_are_those_of_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


DUP = "id long, content_hash string, original_filename string, cluster_id long"


def test_new_duplicates_make_a_cluster(spark):
    photos = spark.createDataFrame([(1, "h", "a.b.jpg", None), (2, "h", "c.jpg", None), (3, "x", "d.jpg", None)], DUP)
    got = {r.id: r for r in C.dup_clusters(photos).collect()}
    assert set(got) == {1, 2} and {r.cluster_id for r in got.values()} == {1} and got[2].cluster_name == "a.b (dup)"


def test_new_duplicate_joins_a_stored_cluster(spark):
    photos = spark.createDataFrame([(1, "h", "a.jpg", 77), (2, "h", "b.jpg", None)], DUP)
    got = {r.id: r for r in C.dup_clusters_incremental(photos, spark.createDataFrame([(2,)], "id long")).collect()}
    assert got[2].cluster_id == 77 and not got[2].is_new_cluster and got[1].is_exact_duplicate == 1


MERGE = "id long, cluster_id long, exif_date string, exif_gps_lat double, exif_gps_lon double, user_cluster_override long, processing_level int"


def merge(spark, similarity, seconds=60, kinds=("content", "content"), place=None, override=None, level=2, batch=None, n=2):
    from math import acos, cos, sin

    turn = acos(similarity)
    photos = [(i + 1, i + 1, at(*divmod(seconds * i, 60)), *((place[i]) if place else (None, None)), override if i == 1 else None, level) for i in range(n)]
    vectors = [(i + 1, [cos(turn * i), sin(turn * i)]) for i in range(n)]
    found = C.merge_clusters_by_embedding(
        spark.createDataFrame(photos, MERGE), spark.createDataFrame([(i + 1, (*kinds, "content")[i]) for i in range(n)], "id long, type string"), spark.createDataFrame(vectors, "photo_id long, embedding array<double>"),
        batch=spark.createDataFrame([(x,) for x in batch], "id long") if batch else None,
    )
    return sorted((r.cluster_id, r.merged_into) for r in found.collect())


def test_merge(spark):
    assert merge(spark, 0.95, 120) == [(2, 1)]
    assert merge(spark, 0.95, 600) == []
    assert merge(spark, 0.50) == []
    assert merge(spark, 0.95, kinds=("dup", "dup")) == []
    assert merge(spark, 0.95, n=3) == [(2, 1), (3, 1)]
    assert merge(spark, 0.99, place=[(55.75, 37.61), (55.76, 37.61)]) == []
    assert merge(spark, 0.99, override=9) == []
    assert merge(spark, 0.99, level=1) == []
    assert merge(spark, 0.99, level=1, batch=[1, 2]) == [(2, 1)]


def test_ranks(spark):
    rows = [(1, 1, 5.0, 600.0, 128.0), (2, 1, 5.0, 600.0, 128.0), (3, 1, 9.0, 100.0, 10.0), (4, 1, None, None, None)]
    df = spark.createDataFrame(rows, "id long, cluster_id long, quality_aesthetic double, quality_blur double, quality_exposure double")
    order = lambda x: [r.id for r in x.orderBy("rank_in_cluster").collect()]
    assert order(C.rank_l1(df)) == [1, 2, 4, 3]
    assert order(C.rank_l2(df)) == [3, 4, 2, 1]


def test_a_match_without_a_cluster_isn_t_replaced(spark):
    old = spark.createDataFrame([(*photo(1, at(0)), None), (*photo(2, at(0), hash_=f"{1:016x}"), 50)], PHOTO + ", cluster_id long")
    got = P.incremental_match(spark.createDataFrame([photo(9, at(1))], PHOTO), old).collect()
    assert [(r.match_id, r.cluster_id) for r in got] == [(1, None)]


def test_bursts_are_those_of_a_walk(spark):
    rng, start = random.Random(8), 1_700_000_000
    rows = [(i, rng.choice([1, 1, 1, 2, None]), start + rng.randrange(40) * 6_000 + rng.randrange(400)) for i in range(600)]
    rows += [(1000 + i, 3, start + 170 * i) for i in range(1200)] + [(3000 + i, 4, start) for i in range(5)]  # over spans without a gap; ties
    df = spark.createDataFrame(rows, "id long, source_id long, secs long")
    dated = df.withColumn("exif_date", F.date_format(F.timestamp_seconds("secs"), "yyyy:MM:dd HH:mm:ss")).unionByName(spark.createDataFrame([(9999, 5, None, None)], "id long, source_id long, secs long, exif_date string"))
    want = []
    for source in {r[1] for r in rows}:
        runs = []
        for secs in sorted(r[2] for r in rows if r[1] == source):
            if not runs or secs - runs[-1][-1] > 180:
                runs.append([])
            runs[-1].append(secs)
        want += [(source, n, len(run), run[0], run[-1]) for n, run in enumerate(runs, 1)]
    key = lambda r: (r[0] or 0, r[1])
    for span in (86_400, 1_000):
        got = [(r.source_id, r.burst, r.photo_count, r.first_s, r.last_s) for r in C.bursts(dated.drop("secs"), span=span).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_a_date_is_parsed_once(spark):
    dates = [("2024:01:02 03:04:05", 1704164645), (" 2024:1:2 3:4:5\t", 1704164645), ("1969:12:31 23:59:59", -1), *((x, None) for x in ("2024-01-02 03:04:05", "\t2024:01:02 03:04:05", "2024:02:30 00:00:00", "a\n2024:01:02 03:04:05", "", None))]
    df = spark.createDataFrame([(i, 1, raw) for i, (raw, _) in enumerate(dates)], "id long, source_id long, exif_date string")
    secs = df.select("id", S.seconds(S.parse_date(F.col("exif_date"))).alias("secs"))
    assert [r.secs for r in secs.orderBy("id").collect()] == [want for _, want in dates]
    named = lambda found: found._jdf.queryExecution().optimizedPlan().toString().count("exif_date#")
    assert named(secs) <= 2  # where it comes in, and where it is parsed
    assert named(C.bursts(df)) == 0  # two sides of a join read what is written, instead of parsing all dates twice


def test_upper_medians(spark):
    rng = random.Random(9)
    rows = [(g, "".join(rng.choice("ab:") for _ in range(rng.choice([1, 10, 11, 12])))) for g in range(12) for _ in range(g * g + 1)] + [(99, "x")] * 4 + [(None, "y")]
    got = {r.g: r.d for r in C.upper_medians(spark.createDataFrame(rows, "g long, d string"), "g", "d").collect()}
    assert got == {g: sorted(d for h, d in rows if h == g)[sum(h == g for h, _ in rows) // 2] for g in {h for h, _ in rows} - {None}}


def test_a_hub_is_dealt(spark):
    """A star's middle, the largest or the smallest id, is met in parts; components are the same."""
    for middle in (10**9, -1):
        edges = spark.range(3000).select(F.col("id").alias("src"), F.lit(middle).cast("long").alias("dst"))
        got = connected_components(edges, hub=100).groupBy("component").count().collect()
        assert [tuple(r) for r in got] == [(min(0, middle), 3001)]


def test_components_in_batches_of_any_order(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)]
    rng.shuffle(edges)
    whole = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    labels, log = spark.createDataFrame([], "node long, component long"), []
    for at in range(0, len(edges), 54):
        changed, merges = extend_components(labels, spark.createDataFrame(edges[at : at + 54], "src long, dst long"))
        log += [tuple(r) for r in merges.collect()]
        labels = spark.createDataFrame([*labels.collect(), *changed.collect()], "node long, component long")
    got = {r.node: r.component for r in labels.groupBy("node").agg(F.min("component").alias("component")).collect()}
    assert {n: c for n, c in got.items() if n in whole} == whole and all(now < was for was, now in log)
    assert len({was for was, _ in log}) == len(log)  # a component merges once


@pytest.mark.parametrize(("radius", "crowd"), [(2, 2), (6, 3), (6, 2000), (4, 1)])
def test_hamming_pairs_of_crowded_bands(spark, radius, crowd):
    rng = random.Random(radius)
    middles = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    bits = {m ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for m in middles for _ in range(25)}
    signed = [(i, b - (1 << 64) if b >> 63 else b) for i, b in enumerate(sorted(bits))]
    got = sorted(map(tuple, P.hamming_pairs(spark.createDataFrame(signed, "id long, bits long"), radius, crowd, 3).collect()))
    whole = sorted(bits)
    assert got == [(i, j, n) for i in range(len(whole)) for j in range(i + 1, len(whole)) if (n := (whole[i] ^ whole[j]).bit_count()) <= radius]


def dense(n: int, seed: int) -> list[tuple]:
    """Photos of some minutes around midnight: few hashes, some near each other, two places, some without one or a date."""
    rng, out = random.Random(seed), []
    for i in range(n):
        secs = rng.choice([rng.randrange(1500), rng.randrange(86400 - 900, 86400 + 900)])
        day, rest = divmod(secs, 86400)
        date = f"2024:05:0{1 + day} {rest // 3600:02}:{rest % 3600 // 60:02}:{rest % 60:02}" if rng.random() < 0.85 else None
        place = (55.0 + rng.choice([0, 0.0003, 0.01]), 37.0) if rng.random() < 0.6 else (None, None)
        out.append((i, date, *place, f"{rng.choice([0, 1, 0xFFFF, 0xFFFF0000, 0xFFFF0001]):016x}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_have_the_closure_of_all_pairs(spark, seed):
    rows = dense(160, seed)
    df = spark.createDataFrame(rows, "id long, exif_date string, exif_gps_lat double, exif_gps_lon double, perceptual_hash string")
    nodes = {r.id: r for r in P.similarity_nodes(df).collect()}
    root = {i: i for i in nodes}
    for a, b in itertools.combinations(sorted(nodes), 2):
        x, y = nodes[a], nodes[b]
        apart = (x.bits ^ y.bits).bit_count()
        if x.grp != y.grp or apart > P.HAMMING[x.grp] or x.grp in ("AB", "DATE") and abs(x.secs - y.secs) > 180 or x.grp in ("AB", "GPS") and abs(x.lat - y.lat) > 0.00045:
            continue
        root = {i: root[a] if r == root[b] else r for i, r in root.items()} if root[a] < root[b] else {i: root[b] if r == root[a] else r for i, r in root.items()}
    got = {r.id: r.cluster_id for r in C.with_components(df.select("id"), P.similarity_edges(df)).collect()}
    assert {i: got[i] for i in nodes} == root


def test_links_of_one_crowded_window_are_few(spark):
    df = spark.range(4000).selectExpr("id", "concat('2024:05:01 12:0', id % 3, ':', lpad(id % 60, 2, '0')) AS exif_date", "55D AS exif_gps_lat", "37D AS exif_gps_lon", "lpad(id % 4, 16, '0') AS perceptual_hash")
    assert P.similarity_edges(df).count() < 2 * 4000
    assert {r.cluster_id for r in C.with_components(df.select("id"), P.similarity_edges(df)).select("cluster_id").distinct().collect()} == {0}


def test_time_bands(spark):
    rng = random.Random(2)
    secs = sorted([rng.randrange(5000) for _ in range(60)] + [86400 * d + rng.randrange(-400, 400) for d in (1, 1, 1, 2, 2, 2, 2) for _ in range(8)] + [77777] * 50)
    got = {r.id: (r.band_id, r.n_links) for r in P.time_bands(spark.createDataFrame(list(enumerate(secs)), "id long, secs long")).collect()}
    first, want = 0, {}
    for i, s in enumerate(secs):
        first = i if i and s - secs[i - 1] > 180 else first
        want[i] = (first, sum(abs(s - t) <= 180 for t in secs) - 1)
    assert got == want


def test_time_band_pairs_of_crowded_times(spark):
    rng = random.Random(9)
    secs = [None, -1, 0, 1, 179, 180, 181, *(rng.randrange(-900, 900) for _ in range(150)), *[4_000] * 120, *[4_180] * 40]
    rows = list(enumerate(secs)) + [(3, 50), (3, 50)]  # ids that repeat don't meet themselves
    df = spark.createDataFrame(rows, "id long, secs long")
    for window in (180, 7, 1):
        want = sorted((a, b, abs(x - y)) for (a, x), (b, y) in itertools.permutations(rows, 2) if a < b and x is not None and y is not None and abs(x - y) <= window)
        for block in (16, 4096):
            found = P.time_band_pairs(df, window, block=block, compared=2_000)
            assert sorted((r.a, r.b, r.gap) for r in found.collect()) == want
    crowd = spark.createDataFrame([(i, 0) for i in range(400)], "id long, secs long")
    shares = P.time_band_pairs(crowd, block=50, compared=1_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in shares) == 400 * 399 // 2
    assert max(r["count"] for r in shares) < 400 * 399 // 8  # one second's pairs come from many tasks


def test_time_band_pairs_compares_chunks_of_a_second(spark):
    rows = [(i if i % 50 else None, 1_000 * (i % 4)) for i in range(1_200)] + [(7, 0), (7, 100), (8, 100)]
    with published_since() as paths:
        found = P.time_band_pairs(spark.createDataFrame(rows, "id long, secs long"))
        got = sorted(map(tuple, found.collect()))
    assert got == sorted((a, b, abs(x - y)) for (a, x), (b, y) in itertools.permutations(rows, 2) if a and b and a < b and abs(x - y) <= 180)
    sizes = [sorted(len(r.ids) for r in t.collect()) for t in map(spark.read.parquet, paths) if "ids" in t.columns]
    assert len(sizes) == 1 and sum(sizes[0]) == sum(bool(i) for i, _ in rows) and sizes[0][-1] == P.CHUNK and len(sizes[0]) < 30
