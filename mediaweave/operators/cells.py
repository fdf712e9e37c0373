"""Unit vectors in cells around pivots: exact neighbours and exact search that skip what the triangle inequality rules out.

A bounded number of vectors are pivots; each vector belongs to the pivot with the smallest angle, and a cell is cut into
units of some thousand vectors by their angle to the pivot. Angles are a metric: |angle(x, p) - angle(y, p)| is never
more than angle(x, y). A vector that wants others within an angle therefore visits only the units whose range of angles
to their pivot comes near its own. How much that saves depends on the vectors: clustered ones visit few units, noise
of many dimensions visits all, and then each row meets each unit once, in bounded memory."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaweave.sources.shared import dealt, publish, staged

#: Pivots at most (they pass through the driver and are broadcast), vectors of a unit, bins of angles that cut a cell.
PIVOTS, UNIT, BINS = 1024, 4096, 1 << 16
#: Units of a block, about, and blocks of a slice: a task compares the vectors of a block with those of a slice.
BLOCK_UNITS, SLICE_BLOCKS = 4, 4
#: Hits that a task holds before it keeps only the best.
HELD = 1 << 20
#: Pivots are the vectors farthest from one another of a sample of so many for each; it fits the index, which holds all.
SAMPLE = 4
#: Angles are compared with that much slack, far more than floating point loses.
SLACK = 1e-6
TILE = 256


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix of unit vectors; a zero vector stays zero."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


@dataclass(frozen=True)
class Index:
    """pivots: a matrix; rows: id, embedding, unit and what else the vectors had; units: unit, cell, lo, hi, n."""

    pivots: np.ndarray
    rows: DataFrame
    units: DataFrame


def _cells(batches, names: list[str], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        apart = angles(unit_rows(batch.column("embedding")), shared.value)
        cell = apart.argmin(1) if len(apart) else np.zeros(0, np.int64)
        near = apart[np.arange(len(apart)), cell]
        made = [pa.array(cell.astype(np.int32)), pa.array(near), pa.array(np.minimum(near / np.pi * BINS, BINS - 1).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)


def farthest(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample, each as far as can be from those before it."""
    chosen, away = [0], angles(sample, sample[:1])[:, 0]
    while len(chosen) < most and away.max() > SLACK:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def with_units(vectors: DataFrame, most_pivots: int = PIVOTS, size: int = UNIT) -> tuple[np.ndarray, DataFrame]:
    """vectors: id, embedding and more. The pivots, and the vectors with cell, near (the angle to the pivot) and unit.

    A cell is cut where its counts by angle say, so that no task sorts a cell; what is at one angle is cut by id."""
    vectors = vectors.filter("embedding IS NOT NULL")
    most = max(1, min(most_pivots, int(vectors.count() ** 0.5)))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).select("embedding").collect()  # bounded by most_pivots
    pivots = farthest(unit_rows(pa.array([list(r.embedding) for r in sample], pa.list_(pa.float64()))), most) if sample else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots if len(pivots) else np.zeros((1, 1)))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.mapInArrow(partial(_cells, names=[*vectors.columns, "cell", "near", "bin"], shared=shared), f"{shape}, cell int, near double, bin int")
    placed = publish(placed)
    bins = placed.groupBy("cell", "bin").agg(F.count("*").alias("n_bin"))
    before = F.sum("n_bin").over(Window.partitionBy("cell").orderBy("bin")) - F.col("n_bin")
    bins = bins.select("cell", "bin", F.floor(before / size).alias("nth"), F.ceil(F.col("n_bin") / size).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    unit = F.col("cell").cast("long") * (1 << 44) + F.col("nth") * (1 << 20) + part
    return pivots, placed.join(bins, ["cell", "bin"]).withColumn("unit", unit).drop("bin", "nth", "parts")


def units_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("unit", "cell").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.count("*").alias("n"))


def cell_index(vectors: DataFrame, most_pivots: int = PIVOTS, size: int = UNIT) -> Index:
    """An index for this run, in the shared folder."""
    pivots, rows = with_units(vectors, most_pivots, size)
    rows = publish(rows)
    return Index(pivots, rows, publish(units_of(rows)))


def write_index(vectors: DataFrame, path: str, most_pivots: int = PIVOTS, size: int = UNIT) -> None:
    """An index that is kept: vectors in a folder a cell, units with their ranges of angles, pivots. path must not exist; it
    appears when all is written."""
    pivots, rows = with_units(vectors, most_pivots, size)
    spark = vectors.sparkSession

    def write(stage: str) -> None:
        rows.repartition("cell", "unit").sortWithinPartitions("cell", "unit").write.partitionBy("cell").parquet(f"{stage}/vectors")
        stored = spark.read.schema(rows.schema).parquet(f"{stage}/vectors")
        units_of(stored).write.parquet(f"{stage}/units")
        spark.createDataFrame([(i, json.dumps(p.tolist())) for i, p in enumerate(pivots)], "cell int, pivot string").write.parquet(f"{stage}/pivots")

    staged(spark, path, write)


def read_index(spark: SparkSession, path: str) -> Index:
    rows = spark.read.schema("cell int, pivot string").parquet(f"{path}/pivots").orderBy("cell").collect()
    pivots = np.array([json.loads(r.pivot) for r in rows]) if rows else np.zeros((0, 1))
    return Index(pivots, spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/units"))


def _near_cells(batches, shared, names: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    pivots, lo, hi = shared.value
    for batch in batches:
        reach = batch.column("reach").to_numpy(zero_copy_only=False)[:, None] + SLACK
        apart = angles(unit_rows(batch.column("embedding")), pivots) if batch.num_rows and len(pivots) else np.zeros((batch.num_rows, len(pivots)))
        row, cell = np.nonzero((apart - reach <= hi) & (apart + reach >= lo))
        taken = [batch.column(c).take(pa.array(row)) for c in columns]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(cell.astype(np.int32)), pa.array(apart[row, cell])], names=names)


def candidates(wanting: DataFrame, index: Index) -> DataFrame:
    """wanting: id, embedding, reach (an angle), and more. For each row the units that may hold a vector within its reach:
    the columns but the vector, unit, n (of the unit), gap (no vector of the unit is nearer)."""
    ranges = {r.cell: (r.lo, r.hi) for r in index.units.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # a row a pivot
    bounds = np.array([ranges.get(c, (np.inf, -np.inf)) for c in range(len(index.pivots))]).reshape(-1, 2)
    shared = wanting.sparkSession.sparkContext.broadcast((index.pivots, bounds[:, 0], bounds[:, 1]))
    fields = [f for f in wanting.schema if f.name != "embedding"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    columns = [f.name for f in fields]
    cells = wanting.mapInArrow(partial(_near_cells, shared=shared, names=[*columns, "cell", "apart"], columns=columns), f"{shape}, cell int, apart double")
    gap = F.greatest(F.lit(0.0), F.col("apart") - F.col("hi"), F.col("lo") - F.col("apart"))
    return cells.join(index.units, "cell").withColumn("gap", gap).filter(F.col("gap") <= F.col("reach") + SLACK).select(*columns, "unit", "n", "gap")


def top_hits(one: pa.Table, other: pa.Table, k: int, least: float, strict: bool, penalty: float) -> pa.Table:
    """one: id, embedding; other: id, embedding (and penalised). Each row's k most similar others above (or at) least, ties
    by id: id, neighbour, similarity."""
    a, b = unit_rows(one.column("embedding")), unit_rows(other.column("embedding"))
    ids_a, ids_b = one.column("id").to_numpy(), other.column("id").to_numpy()
    less = penalty * other.column("penalised").to_numpy(zero_copy_only=False) if penalty else 0.0
    found = []
    for at in range(0, len(a), TILE):
        scores = a[at : at + TILE] @ b.T - less
        hit = scores > least if strict else scores >= least
        if strict:  # neighbours: not the row itself
            hit &= ids_a[at : at + TILE, None] != ids_b
        i, j = np.nonzero(hit)
        s = scores[i, j]
        order = np.lexsort((ids_b[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        found.append((ids_a[at + i[top]], ids_b[j[top]], s[top]))
    columns = [np.concatenate([x[c] for x in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(columns, names=["id", "neighbour", "similarity"])


HITS = "id long, neighbour long, similarity double"


def meet(visits: DataFrame, wanting: DataFrame, index_rows: DataFrame, top, size: int = UNIT) -> DataFrame:
    """visits: id, unit (written); wanting: id, embedding. Each visitor with the vectors of the unit: HITS. Visitors of a unit
    are dealt into parts of bounded size, with a copy of the unit in each."""
    parts = publish(visits.groupBy("unit").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")))
    visitors = visits.select("id", "unit").join(parts, "unit").withColumn("part", F.pmod(F.xxhash64("id", "unit"), F.col("parts")).cast("int"))
    visitors = visitors.join(wanting.select("id", "embedding"), "id").select(*(F.col(c).alias(c) for c in ("unit", "part", "id", "embedding")))  # columns of their own
    copies = index_rows.join(parts, "unit").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = [c for c in ("unit", "part", "id", "embedding", "penalised") if c in copies.columns]
    copies = copies.select(*(F.col(c).alias(c) for c in kept))
    together = visitors.groupBy("unit", "part").cogroup(copies.groupBy("unit", "part"))
    return together.applyInArrow(lambda one, other: top(one, other), HITS)


def blocks_of(units: DataFrame, size: int) -> DataFrame:
    """unit, cell, lo, hi, block: units in their order, cut into blocks of about so many vectors. A row a pivot is added up as
    one, the rest by cells."""
    totals = units.groupBy("cell").agg(F.sum("n").alias("n_cell"))
    totals = totals.select("cell", (F.sum("n_cell").over(Window.orderBy("cell")) - F.col("n_cell")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("cell").orderBy("unit")) - F.col("n")
    return units.withColumn("within", within).join(totals, "cell").select("unit", "cell", "lo", "hi", F.floor((F.col("before") + F.col("within")) / size).alias("block"))


def _spans(batches, shared) -> Iterator[pa.RecordBatch]:
    pivots = shared.value
    for batch in batches:
        if batch.num_rows:
            reach, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("reach", "block"))
            apart = angles(unit_rows(batch.column("embedding")), pivots)
            for one in np.unique(block):
                at = block == one
                least, most = (apart[at] - reach[at, None]).min(0) - SLACK, (apart[at] + reach[at, None]).max(0) + SLACK
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(least), one)), pa.array(np.arange(len(least), dtype=np.int32)), pa.array(least), pa.array(most)], names=["block", "cell", "least", "most"])


def block_visits(wanting: DataFrame, blocks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """wanting: embedding, block, reach. The units that may hold a vector within the reach of one of a block: block, unit."""
    shared = wanting.sparkSession.sparkContext.broadcast(pivots)
    spans = wanting.select("embedding", "block", "reach").mapInArrow(partial(_spans, shared=shared), "block long, cell int, least double, most double")
    spans = spans.groupBy("block", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return spans.join(blocks.drop("block"), "cell").filter("lo <= most AND hi >= least").select("block", "unit")


def best_hits(hits: list, k: int) -> list:
    """(row, neighbour, similarity) of many comparisons: of each row the k best, ties by neighbour, in the order of rows."""
    i, other, s = (np.concatenate([h[c] for h in hits]) for c in range(3))
    order = np.lexsort((other, -s, i))
    i, other, s = i[order], other[order], s[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return [(i[top], other[top], s[top])]


def block_hits(one: pa.Table, other: pa.Table, shared, k: int, least: float) -> pa.Table:
    """one: id, embedding, unit, known (the similarity of the k-th neighbour so far, or null); other: id, embedding, unit, cell,
    near. Each row's k most similar others above least, of the units but its own that its reach comes near. What is found
    in one unit bounds how far a row looks in the next."""
    a, ids, own = unit_rows(one.column("embedding")), one.column("id").to_numpy(), one.column("unit").to_numpy()
    known = one.column("known").to_numpy(zero_copy_only=False).astype(np.float64)
    bound = np.where(np.isnan(known), least, known - SLACK**2)  # a hair less: a k-th similarity may round otherwise here
    units = other.column("unit").to_numpy()
    order = np.argsort(units, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(units[order]) != 0]) if len(order) else []
    b, ids_b, near, cell = unit_rows(other.column("embedding")), other.column("id").to_numpy(), other.column("near").to_numpy(), other.column("cell").to_numpy()
    hits, held = [], 0
    for at, end in zip(starts, [*starts[1:], len(order)], strict=True):
        rows = order[at:end]
        apart = angles(a, shared.value[cell[rows[:1]]])[:, 0]
        reach = np.arccos(np.clip(bound, -1, 1)) + SLACK
        visitors = np.flatnonzero((own != units[rows[0]]) & (apart - reach <= near[rows].max()) & (apart + reach >= near[rows].min()))
        for part in range(0, len(visitors), TILE):
            v = visitors[part : part + TILE]
            scores = a[v] @ b[rows].T
            i, j = np.nonzero(scores >= bound[v, None])
            s = scores[i, j]
            i, other_id = v[i], ids_b[rows[j]]
            hit = (s > least) & (ids[i] != other_id)
            hits.append((i[hit], other_id[hit], s[hit]))
            held += int(hit.sum())
        if held > HELD:
            hits = best_hits(hits, k)
            i, _, s = hits[0]
            held, last = 0, np.flatnonzero(np.bincount(i, minlength=len(a)) == k)
            bound[last] = np.maximum(bound[last], s[np.searchsorted(i, last, side="right") - 1] - SLACK**2)
    i, other_id, s = best_hits(hits, k)[0] if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([ids[i], other_id, s], names=["id", "neighbour", "similarity"])


def neighbours(index: Index, k: int, least: float, size: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """The k most similar others of each vector of an index above least, exactly, ties by id: id, neighbour, similarity,
    rank. Also the visits that this takes at most (id, unit, n), which are not written.

    A vector meets its own unit first; the similarity of its k-th neighbour there bounds how far it has to look. Then blocks
    of some units meet slices of all units that one of their vectors may reach, a copy of a vector a block or slice and
    not one a unit, and of a slice a vector's k best leave the task."""
    top = partial(top_hits, k=k, least=least, strict=True, penalty=0.0)
    rows = index.rows.select("id", "embedding", "unit")
    own = publish(rows.groupBy("unit").applyInArrow(lambda t: top(t, t), HITS))
    full = own.groupBy("id").agg(F.count("*").alias("found"), F.min("similarity").alias("least")).filter(F.col("found") >= k).select("id", F.col("least").alias("known"))
    blocks = publish(blocks_of(index.units, BLOCK_UNITS * size))
    reach = F.acos(F.least(F.lit(1.0), F.coalesce("known", F.lit(float(least)))))
    wanting = publish(rows.join(dealt(full), "id", "left").join(blocks.select("unit", "block"), "unit").withColumn("reach", reach))
    slice_ = F.floor(F.col("block") / SLICE_BLOCKS)
    to = blocks.select("unit", slice_.alias("slice"))
    visits = publish(block_visits(wanting, blocks, index.pivots).join(to, "unit"))
    visitors = wanting.join(dealt(visits.select("block", "slice").distinct()), "block").select(*(F.col(c).alias(c) for c in ("block", "slice", "id", "embedding", "unit", "known")))  # columns of their own
    copies = index.rows.join(dealt(visits), "unit").select(*(F.col(c).alias(c) for c in ("block", "slice", "id", "embedding", "unit", "cell", "near")))
    shared = rows.sparkSession.sparkContext.broadcast(index.pivots)
    together = visitors.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice"))
    found = own.unionAll(together.applyInArrow(lambda one, other: block_hits(one, other, shared, k, least), HITS))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    each = candidates(wanting.select("id", "embedding", F.col("unit").alias("own"), "reach"), index).filter("unit <> own").select("id", "unit", "n")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k), each


def only_cells(index: Index, visits: DataFrame) -> DataFrame:
    """The index's rows of the cells that visits name: folders of others aren't listed or read. One number a pivot passes
    through the driver."""
    named = visits.select(F.shiftright("unit", 44).cast("int").alias("cell")).distinct().collect()
    return index.rows.filter(F.col("cell").isin([r.cell for r in named]))


def search(index: Index, queries: DataFrame, least: float, limit: int, penalty: float, size: int = UNIT) -> DataFrame:
    """queries: id, embedding. For each the limit most similar vectors at or above least, exactly, `penalised` ones (0 or 1)
    with a penalty, ties by id: id, neighbour, similarity, rank. Queries are a table and stay one.

    A query meets the unit that looks best first; what it finds there tells which of the others can still add to it."""
    top = partial(top_hits, k=limit, least=least, strict=False, penalty=penalty)
    queries = publish(queries.filter("embedding IS NOT NULL").select("id", "embedding"))
    near = publish(candidates(queries.withColumn("reach", F.acos(F.lit(float(min(1.0, max(-1.0, least)))))), index).select("id", "unit", "gap"))
    best = publish(near.groupBy("id").agg(F.min(F.struct("gap", "unit")).alias("best")).select("id", "best.unit"))
    first = publish(meet(best, queries, only_cells(index, best), top, size))
    full = first.groupBy("id").agg(F.count("*").alias("found"), F.min("similarity").alias("least")).filter(F.col("found") >= limit).select("id", "least")
    open_ = F.col("gap") <= F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("least", F.lit(float(least)))))) + SLACK
    rest = publish(near.join(best.withColumnRenamed("unit", "done"), "id").filter("unit <> done").join(full, "id", "left").filter(open_).select("id", "unit"))
    hits = first.unionAll(meet(rest, queries, only_cells(index, rest), top, size))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit)
