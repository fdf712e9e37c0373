"""Pair joins: candidates by equi-joins on buckets, then the exact condition. Each pair comes once, with a < b."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.functions.constants import GPS_RADIUS_M, HAMMING, TIME_WINDOW_S
from mediaweave.sources.shared import dealt, publish

#: Seconds of a span, within which runs are found.
SPAN = 86_400
CELL_DEGREES = 0.00045  # of latitude: a little over the radius of 50 m


def time_buckets(secs: Column, window: int) -> Column:
    return F.floor(secs / window)


def near_buckets(bucket: Column) -> Column:
    return F.explode(F.array(bucket - 1, bucket, bucket + 1))


#: Buckets of a window in time_band_pairs(), how many rows of a bucket one task takes from each side, and how many ids of a
#: second are compared as one row at most.
STEPS, BLOCK, CHUNK = 4, 4096, 64
#: Pairs of rows that a task of time_band_pairs() compares, as far as they are dealt evenly and to no more tasks than that.
COMPARED, MOST_TASKS = 20_000_000, 50_000


def second_chunks(points: DataFrame, block: int, chunk: int) -> DataFrame:
    """points: id, secs. secs, ids: rows that hold up to chunk ids of a second each. Of a crowded second about `block` ids are
    collected at once."""
    points = publish(points.filter("id IS NOT NULL AND secs IS NOT NULL").select("id", "secs", F.xxhash64(F.monotonically_increasing_id()).alias("deal")))
    counts = points.groupBy("secs").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    block = max(block, total // MOST_CROWDED)
    keys = ["secs"]
    if most > block:
        crowded = counts.filter(F.col("n") > block).select("secs", F.ceil(F.col("n") / block).alias("parts"))
        points, keys = points.join(F.broadcast(crowded), "secs", "left").withColumn("part", F.pmod("deal", F.coalesce("parts", F.lit(1)))), ["secs", "part"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = points.select("id", *keys).repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list("id").alias("ids"))
    if most <= chunk:
        return held
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(chunk))
    return held.select("secs", F.explode(F.transform(starts, lambda at: F.slice("ids", at, F.lit(chunk)))).alias("ids"))


def time_band_pairs(points: DataFrame, window: int = TIME_WINDOW_S, block: int = BLOCK, compared: int = COMPARED) -> DataFrame:
    """points: id, secs. Pairs at most window seconds apart.

    The ids of a second are compared by chunks: two chunks within the window give all pairs of their ids. A window is STEPS
    buckets wide. A chunk meets those of its own bucket and of the next STEPS ones, so that nearly all it meets are near.
    Buckets where over `block` ids meet are cut on both sides, and each part of one meets each of the other."""
    bucket = F.floor(F.col("secs") * STEPS / window)
    chunks = second_chunks(points, block, max(1, min(CHUNK, block // 8)))
    chunks = publish(chunks.select("secs", "ids", F.size("ids").alias("n"), bucket.alias("own"), F.monotonically_increasing_id().alias("chunk")))
    ahead = F.explode(F.sequence(F.col("own"), F.col("own") + STEPS)).alias("bucket")
    counts = chunks.groupBy("own").agg(F.sum("n").alias("n"))
    meet = counts.select("own", "n", ahead).select("bucket", F.col("n").alias("n_p"), F.when(F.col("own") == F.col("bucket"), F.col("n")).otherwise(0).alias("n_q"))
    meet = meet.groupBy("bucket").agg(F.sum("n_p").alias("n_p"), F.sum("n_q").alias("n_q")).filter("n_q > 0")
    total, met, most = (x or 0 for x in meet.agg(F.sum(F.col("n_p") * F.col("n_q")), F.sum("n_p"), F.max("n_p")).first())
    block = max(block, met // MOST_CROWDED)
    part = lambda n: F.ceil(F.col(n) / block).cast("int")
    crowded = meet.select("bucket", part("n_p").alias("p"), part("n_q").alias("q")).filter("p > 1")
    cut = most > block
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-total // compared)))

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        keys = ["bucket"]
        if cut:
            deal = F.xxhash64(f"chunk_{own}")
            df = df.join(F.broadcast(crowded), "bucket", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in "pq"})
            df = df.withColumn(f"nth_{own}", F.pmod(deal, F.col(own)).cast("int")).withColumn(f"nth_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            keys += ["nth_p", "nth_q"]
        return df.drop("p", "q").repartition(tasks, *keys)

    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("ids", "secs", "chunk")]
    left = side(chunks.select(*named("p"), "own", ahead).withColumn("same", F.col("own") == F.col("bucket")).drop("own"), "p", "q")
    right = side(chunks.select(*named("q"), F.col("own").alias("bucket")), "q", "p")
    gap = F.abs(F.col("secs_p") - F.col("secs_q"))
    met = left.join(dealt(right), ["bucket", "nth_p", "nth_q"] if cut else "bucket")
    met = met.filter((~F.col("same") | (F.col("chunk_p") <= F.col("chunk_q"))) & (gap <= window))
    met = met.select("ids_p", "ids_q", gap.alias("gap"), (F.col("chunk_p") == F.col("chunk_q")).alias("itself"))
    met = met.select(F.explode("ids_p").alias("a"), "ids_q", "gap", "itself").select("a", F.explode("ids_q").alias("b"), "gap", "itself")
    met = met.filter((F.col("a") < F.col("b")) | ~F.col("itself") & (F.col("a") > F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "gap")


def time_bands(points: DataFrame, window: int = TIME_WINDOW_S, span: int = SPAN) -> DataFrame:
    """points: id, secs. time_band_pairs() as classes: one row a point with band_id, the smallest id that a chain of points
    at most window seconds apart reaches, and n_links, how many others are at most so far from it itself.

    Seconds are counted first, map-side. They are worked on by spans of time, each with the seconds next to it; of the
    bands only what goes on from one span to the next is joined across spans, a row a span."""
    points = points.filter("secs IS NOT NULL").select("id", "secs")
    moments = publish(points.groupBy("secs").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("span", F.floor(F.col("secs") / span)))
    beside = F.array_distinct(F.transform(F.array(F.col("secs") - window, F.col("secs"), F.col("secs") + window), lambda x: F.floor(x / span)))
    halo = moments.withColumn("in", F.explode(beside))
    count = F.sum("n").over(Window.partitionBy("in").orderBy("secs").rangeBetween(-window, window)) - 1
    links = halo.withColumn("n_links", count).filter("`in` = span").select("secs", "n_links")
    within, along = Window.partitionBy("span").orderBy("secs"), Window.orderBy("span")
    new = F.coalesce((F.col("secs") - F.lag("secs").over(within) > window).cast("long"), F.lit(0))
    cut = moments.withColumn("new", new).withColumn("nth", F.sum("new").over(within)).drop("new")
    spans = cut.groupBy("span").agg(F.max("nth").alias("k"), F.min("secs").alias("start"), F.max("secs").alias("end"))
    goes_on = F.coalesce((F.col("start") - F.lag("end").over(along) <= window).cast("long"), F.lit(0))
    spans = spans.withColumn("fresh", F.col("k") + 1 - goes_on).select("span", (F.sum("fresh").over(along) - F.col("k")).alias("number"))
    bands = publish(cut.join(spans, "span").select("secs", "least", (F.col("number") + F.col("nth")).alias("number")))
    named = bands.groupBy("number").agg(F.min("least").alias("band_id"))
    return points.join(bands.join(named, "number").join(links, "secs").select("secs", "band_id", "n_links"), "secs").select("id", "band_id", "n_links")


def grid_row(lat: Column, cell: float) -> Column:
    return F.floor(lat / cell)


def grid_columns(row: Column, cell: float) -> Column:
    """Equal cells around the globe in a row, each as wide as the cell in its neighbour rows too."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row - 1), F.abs(row + 2)) * cell)
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / cell))


def grid_column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * columns), columns)


def own_cell(lat: Column, lon: Column, cell: float) -> list[Column]:
    row = grid_row(lat, cell)
    return [row.alias("cell_row"), grid_column(lon, grid_columns(row, cell)).alias("cell_column")]


def near_cells(df: DataFrame, lat: str, lon: str, cell: float) -> DataFrame:
    """A row for each cell that may hold points within a cell's height: three rows, three columns each."""
    row = grid_row(F.col(lat), cell)
    df = df.withColumn("cell_row", F.explode(F.array(row - 1, row, row + 1)))
    columns = grid_columns(F.col("cell_row"), cell)
    own = grid_column(F.col(lon), columns)
    return df.withColumn("cell_column", F.explode(F.array_distinct(F.array(F.pmod(own - 1, columns), own, F.pmod(own + 1, columns)))))


def geo_radius_pairs(points: DataFrame, metres: float = GPS_RADIUS_M) -> DataFrame:
    """points: id, lat, lon. Pairs at most so many metres apart."""
    cell = CELL_DEGREES * metres / GPS_RADIUS_M
    points = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    left = near_cells(points.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a")), "lat_a", "lon_a", cell)
    right = points.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), *own_cell(F.col("lat"), F.col("lon"), cell))
    metres_ = S.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return left.join(dealt(right), ["cell_row", "cell_column"]).filter(F.col("a") < F.col("b")).withColumn("metres", metres_).filter(F.col("metres") <= metres).select("a", "b", "metres")


def band_masks(radius: int) -> list[int]:
    """Masks of radius + 1 bands of the 64 bits, as signed numbers."""
    n, out, at = radius + 1, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        mask = ((1 << width) - 1) << at
        out.append(mask - (1 << 64) if mask >> 63 else mask)
        at += width
    return out


def hash_bands(bits: Column, radius: int) -> Column:
    """An array of the bands of a hash: two hashes within the radius are equal in one of them."""
    return F.array(*(bits.bitwiseAND(F.lit(m)) for m in band_masks(radius)))


def first_equal_band(a: Column, b: Column, radius: int) -> Column:
    """The number of the first band in which two hashes are equal, by which their pair is taken once."""
    differ = a.bitwiseXOR(b)
    return F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(band_masks(radius))), F.lit(-1))


def mask_of(bits: list[int]) -> int:
    """The mask of some of the 64 bits, as a signed number."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


#: A bucket of more hashes than that is dealt again by bands of the bits that its key leaves free, so many times at most.
CROWD, LEVELS = 2000, 4
#: Crowded keys that are copied to every task; there are no more of them than rows by CROWD.
MOST_CROWDED = 100_000


def hamming_pairs(points: DataFrame, radius: int, crowd: int = CROWD, levels: int = LEVELS) -> DataFrame:
    """points: id, bits, hashes that are all different for the buckets to be worth it. Pairs of hashes that differ in at
    most radius bits, exactly: a, b, bits_apart.

    Two such hashes are equal in one of radius + 1 bands of bits. A band's bucket with over crowd hashes is dealt again:
    there too, bands of the other bits have one in which the two are equal. A pair is taken in the first such band at
    every level, and so once: `differ` holds the masks of the bands before, in which it must not be equal."""
    state, parents, found = points.filter("bits IS NOT NULL").select("id", "bits", F.lit(0).alias("path")), {0: ([], [])}, []
    for level in range(levels):
        paths, deal = {}, F.lit(None)
        for parent, (used, differ) in parents.items():
            free = [b for b in range(64) if b not in used]
            cuts = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
            bands = [free[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
            own = []
            for i, band in enumerate(bands):
                path = parent * (radius + 2) + i + 1
                paths[path] = (used + band, differ + [mask_of(x) for x in bands[:i]])
                own.append(F.struct(F.lit(path).alias("path"), F.lit(mask_of(used + band)).alias("mask"), F.array(*map(F.lit, paths[path][1])).cast("array<long>").alias("differ")))
            deal = F.when(F.col("path") == parent, F.array(*own)).otherwise(deal)
        placed = state.select("id", "bits", F.explode(deal).alias("to")).select("id", "bits", "to.path", F.col("bits").bitwiseAND(F.col("to.mask")).alias("key"), F.col("to.differ").alias("differ"))
        more = level < levels - 1 and max(64 - len(used) for used, _ in paths.values()) > radius + 1
        crowded = publish(placed.groupBy("path", "key").count().filter(F.col("count") > crowd).select("path", "key")) if more else None
        again = crowded is not None and not crowded.isEmpty()
        if again and crowded.count() <= MOST_CROWDED:
            crowded = F.broadcast(crowded)
        ready = placed.join(crowded, ["path", "key"], "left_anti") if again else placed
        left, right = ready.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"), "path", "key", "differ"), ready.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"), "path", "key")
        apart = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
        first = F.forall("differ", lambda m: apart.bitwiseAND(m) != 0)
        met = left.join(dealt(right), ["path", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & first)
        found.append(met.select("a", "b", F.bit_count(apart).cast("int").alias("bits_apart")))
        if not again:
            break
        state = publish(placed.join(crowded, ["path", "key"], "left_semi").select("id", "bits", "path"))
        parents = {path: paths[path] for (path,) in state.select("path").distinct().collect()}  # bounded by bands and levels
    return reduce(DataFrame.unionAll, found)


def class_heads(points: DataFrame, *columns: str) -> DataFrame:
    """Rows that are equal in the columns as one: the columns, id (the smallest), n."""
    return publish(points.groupBy(*columns).agg(F.min("id").alias("id"), F.count("*").alias("n")))


def class_links(pairs: DataFrame, heads: DataFrame, distance: str, none: float) -> DataFrame:
    """Pairs of heads, and each head of more than one row with itself, with the number of links that they stand for."""
    for side in ("a", "b"):
        pairs = pairs.join(dealt(heads.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"))), side)
    pairs = pairs.select("a", "b", distance, (F.col("n_a") * F.col("n_b")).alias("links"))
    inner = heads.filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(none).cast(pairs.schema[distance].dataType).alias(distance), F.expr("n * (n - 1) DIV 2").alias("links"))
    return pairs.unionByName(inner)


def similarity_nodes(photos: DataFrame) -> DataFrame:
    """id, exif_date, grp, secs, lat, lon, bits of the photos that have a hash, written once: every join reads them."""
    date, lat, lon = F.col("exif_date"), F.col("exif_gps_lat"), F.col("exif_gps_lon")
    nodes = photos.select("id", "exif_date", S.photo_group(date, lat, lon).alias("grp"), S.seconds(S.parse_date(date)).alias("secs"), lat.alias("lat"), lon.alias("lon"), S.hash_bits(F.col("perceptual_hash")).alias("bits"))
    return publish(nodes.filter("bits IS NOT NULL"))


def time_runs(moments: DataFrame, keys: list[str], gap: int, span: int = SPAN) -> DataFrame:
    """moments: id, secs and the keys, one row a second of a key. Adds run, the smallest id of the moments of the key's run
    (each at most gap seconds after the one before), and its first and last second. Runs are cut at spans of time, which
    bounds what a task sorts; two that go on into one another are as near as any."""
    cut = moments.withColumn("span", F.floor(F.col("secs") / span))
    along = Window.partitionBy(*keys, "span").orderBy("secs")
    cut = cut.withColumn("new", F.coalesce((F.col("secs") - F.lag("secs").over(along) > gap).cast("long"), F.lit(0))).withColumn("nth", F.sum("new").over(along))
    within = Window.partitionBy(*keys, "span", "nth")
    return cut.withColumns({"run": F.min("id").over(within), "first": F.min("secs").over(within), "last": F.max("secs").over(within)}).drop("span", "new", "nth")


def meeting_buckets(window: int) -> tuple[Column, Column]:
    """Buckets of an interval (first, last), and those of intervals that may come within the window of it. Seconds of a run
    are never far from each other, so that it has no more buckets than about two a moment."""
    lo, hi = F.floor(F.col("first") / window), F.floor(F.col("last") / window)
    return F.sequence(lo, hi), F.sequence(lo - 1, hi + 1)


def similarity_edges(photos: DataFrame, limits: dict[str, int] = HAMMING, window: int = TIME_WINDOW_S, metres: float = GPS_RADIUS_M) -> DataFrame:
    """Links (a, b) whose closure is the closure of all similar pairs of a group.

    Photos that are equal in all that counts are one node first, each linked to its smallest id. Where time counts, the
    seconds of one hash at one place that follow one another within the window are a run, linked to its smallest id as
    well: another hash near it is near one of its photos exactly if it is near the run's time, so that runs are compared
    and not their photos. A spot where some hashes come again and again costs a row a photo and not a pair each."""
    nodes = similarity_nodes(photos).filter("grp IN ('GPS', 'NONE') OR secs IS NOT NULL")
    same = ["grp", "bits", F.expr("CASE WHEN grp IN ('AB', 'DATE') THEN secs END").alias("secs"), F.expr("CASE WHEN grp IN ('AB', 'GPS') THEN lat END").alias("lat"), F.expr("CASE WHEN grp IN ('AB', 'GPS') THEN lon END").alias("lon")]
    keyed = nodes.select("id", *same)
    heads = publish(keyed.groupBy("grp", "bits", "secs", "lat", "lon").agg(F.min("id").alias("id")))
    keys = ["grp", "bits", "secs", "lat", "lon"]
    copies = keyed.alias("x").join(dealt(heads.withColumnRenamed("id", "head")).alias("y"), reduce(lambda p, q: p & q, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys))).filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    timed = publish(time_runs(heads.filter("secs IS NOT NULL"), ["grp", "bits", "lat", "lon"], window))
    inner = timed.filter("id <> run").select(F.col("run").alias("a"), F.col("id").alias("b"))
    runs = publish(timed.filter("id = run").drop("secs", "run"))
    cell = CELL_DEGREES * metres / GPS_RADIUS_M
    near_bits = S.hamming(F.col("bits_a"), F.col("bits_b"))
    near_time = (F.col("first_b") - F.col("last_a") <= window) & (F.col("first_a") - F.col("last_b") <= window)
    near_place = S.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= metres
    ordered = F.col("id_a") < F.col("id_b")
    here = own_cell(F.col("lat_b"), F.col("lon_b"), cell)
    cells = ["cell_row", "cell_column"]
    own, near = meeting_buckets(window)

    def sides(df: DataFrame, grp: str) -> list[DataFrame]:
        df = df.filter(F.col("grp") == grp).drop("grp")
        return [df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns)) for side in ("a", "b")]

    def in_time(grp: str) -> tuple[DataFrame, DataFrame, Column]:
        """Runs by bucket, and that a pair is in the first of its buckets."""
        left, right = sides(runs.withColumns({"near": near, "own": own}), grp)
        left = left.select("*", F.element_at("near_a", 1).alias("start_a"), F.explode("near_a").alias("bucket")).drop("near_a", "own_a")
        right = right.select("*", F.element_at("own_b", 1).alias("start_b"), F.explode("own_b").alias("bucket")).drop("near_b", "own_b")
        return left, right, F.col("bucket") == F.greatest("start_a", "start_b")

    left, right, once_ = in_time("AB")
    both = near_cells(left, "lat_a", "lon_a", cell).join(dealt(right.select("*", *here)), ["bucket", *cells]).filter(ordered & once_ & near_time & near_place & (near_bits <= limits["AB"]))
    left, right, once_ = in_time("DATE")
    dated = left.join(dealt(right), "bucket").filter(ordered & once_ & near_time & (near_bits <= limits["DATE"]))

    def banded(side: DataFrame, bits: str, radius: int, *more: Column) -> DataFrame:
        return side.select("*", *more, F.posexplode(hash_bands(F.col(bits), radius)).alias("band", "key"))

    once = ordered & (near_bits <= limits["GPS"]) & (first_equal_band(F.col("bits_a"), F.col("bits_b"), limits["GPS"]) == F.col("band"))
    left, right = sides(heads, "GPS")
    placed = near_cells(banded(left, "bits_a", limits["GPS"]), "lat_a", "lon_a", cell).join(dealt(banded(right, "bits_b", limits["GPS"], *here)), ["band", "key", *cells]).filter(once & near_place)
    bare = hamming_pairs(heads.filter("grp = 'NONE'").select("id", "bits"), limits["NONE"])
    pairs = [x.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")) for x in (both, dated, placed)]
    return reduce(DataFrame.unionByName, [copies, inner, *pairs, bare.select("a", "b")])


def incremental_match(new: DataFrame, old: DataFrame, limits: dict[str, int] = HAMMING, window: int = TIME_WINDOW_S, metres: float = GPS_RADIUS_M) -> DataFrame:
    """For each new photo the most similar stored one of its group, ties by (exif_date, id): id, match_id, bits_apart,
    cluster_id. The winner counts only if it has a cluster; there is no second choice. old: also cluster_id.

    Candidates come by bucket: time and place, place, time, or bands of the hash. Where time doesn't count, stored photos
    that are equal in all that does are one.
    A new photo whose date can't be read has no time gate; without coordinates it is found by bands of the hash."""
    cell = CELL_DEGREES * metres / GPS_RADIUS_M
    a, b = similarity_nodes(new), similarity_nodes(old.drop("cluster_id")).join(dealt(old.select("id", "cluster_id")), "id")
    a = a.select(*(F.col(c).alias(f"{c}_a") for c in ("id", "grp", "secs", "lat", "lon", "bits")))
    b = b.select(*(F.col(c).alias(f"{c}_b") for c in ("id", "grp", "secs", "lat", "lon", "bits", "exif_date", "cluster_id")))
    apart = S.hamming(F.col("bits_a"), F.col("bits_b"))
    near_place = S.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= metres
    near_time = F.abs(F.col("secs_a") - F.col("secs_b")) <= window
    here = own_cell(F.col("lat_b"), F.col("lon_b"), cell)
    cols = ["id_a", "id_b", "exif_date_b", "cluster_id_b", apart.cast("int").alias("apart")]
    spot = ["bits_b", "lat_b", "lon_b"]

    def heads(grp: str, *keys: str) -> DataFrame:
        """Stored photos of a group; of those that are equal in the keys the one that wins ties."""
        first = F.min(F.struct("exif_date_b", "id_b", "cluster_id_b")).alias("first")
        return b.filter(F.col("grp_b") == grp).groupBy(*keys).agg(first).select(*keys, "first.*")

    bucket_a, bucket_b = near_buckets(time_buckets(F.col("secs_a"), window)).alias("bucket"), time_buckets(F.col("secs_b"), window).alias("bucket")
    cells = ["cell_row", "cell_column"]
    timed = near_cells(a.filter("grp_a = 'AB' AND secs_a IS NOT NULL").select("*", bucket_a), "lat_a", "lon_a", cell).join(dealt(b.filter("grp_b = 'AB'").select("*", bucket_b, *here)), ["bucket", *cells])
    found = [timed.filter(near_place & near_time & (apart <= limits["AB"])).select(*cols)]
    for left, grp in ((a.filter("grp_a = 'AB' AND secs_a IS NULL"), "AB"), (a.filter("grp_a = 'GPS'"), "GPS")):
        placed = near_cells(left, "lat_a", "lon_a", cell).join(dealt(heads(grp, *spot).select("*", *here)), cells)
        found.append(placed.filter(near_place & (apart <= limits[grp])).select(*cols))
    dated = a.filter("grp_a = 'DATE' AND secs_a IS NOT NULL").select("*", bucket_a).join(dealt(b.filter("grp_b = 'DATE'").select("*", bucket_b)), "bucket")
    found.append(dated.filter(near_time & (apart <= limits["DATE"])).select(*cols))
    for left, grp in ((a.filter("grp_a = 'NONE'"), "NONE"), (a.filter("grp_a = 'DATE' AND secs_a IS NULL"), "DATE")):
        radius = limits[grp]
        bands = [side.select("*", F.posexplode(hash_bands(F.col(bits), radius)).alias("band", "key")) for side, bits in ((left, "bits_a"), (heads(grp, "bits_b"), "bits_b"))]
        found.append(bands[0].join(dealt(bands[1]), ["band", "key"]).filter((apart <= radius) & (first_equal_band(F.col("bits_a"), F.col("bits_b"), radius) == F.col("band"))).select(*cols))
    pairs = reduce(DataFrame.unionByName, found)
    best = pairs.groupBy("id_a").agg(F.min(F.struct("apart", "exif_date_b", "id_b", "cluster_id_b")).alias("best"))
    return best.select(F.col("id_a").alias("id"), F.col("best.id_b").alias("match_id"), F.col("best.apart").alias("bits_apart"), F.col("best.cluster_id_b").alias("cluster_id"))
