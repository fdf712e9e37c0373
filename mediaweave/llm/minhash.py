"""13. MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, stars of candidates.

A text's set of word shingles is hashed once; the smallest hash in each of BINS equal ranges is its signature, and an
empty bin takes the value of the first bin that isn't empty in an order of all bins of its own (a hash decides it, the
same for all texts), so that two signatures agree in a bin as often as their sets overlap. Bands of ROWS bins are the
keys of buckets. Equal sets are one class from the start, whatever their number.

Buckets give stars, not pairs: each class of a bucket is a candidate with the bucket's smallest class alone, and full
sets confirm it. The links found make components; a bucket whose classes are all of one component is done. What is
left of a bucket is compared within: each class with those of other components, breadth first. A bucket over CROWD
bytes is dealt again by its classes' other bands first, and cut into blocks of bounded size that meet two by two if it
is still too large, so that no comparison is left out.

Two sets with a similarity of 0.85 share no bucket once in 4 * 10 ** 6; at 0.9 once in 10 ** 10.

Defined results: a null or empty text, and one without words, has no shingles and links to nothing; a text of fewer
words than a shingle is one shingle; a null doc_id counts in no component's smallest doc_id (a component without any
other has null, and its rows are kept); repeated rows are rows; an empty table gives an empty result; a text may be of
any length, as it is one row: its set takes eight bytes a shingle in one task. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import join_by_size, publish, shared_dir, small_batches, table
from mediaweave.llm.simhash import shingle_hashes
from mediaweave.operators.components import connected_components

WORDS, SEED = 5, 42
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Per cent: sets link if 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
#: Bytes of sets that one bucket may compare in a task.
CROWD = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number mapped to another one, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each bin the order in which it looks for one that isn't empty, itself first.
ORDER = np.argsort(mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS) * ~np.eye(BINS, dtype=bool), axis=1, kind="stable")
ODD = mixed(np.arange(1, BINS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The value of each bin. hashes: of a set that isn't empty, sorted."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.searchsorted(bins, np.arange(BINS, dtype=np.uint64))
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty = np.flatnonzero(~full)
    order = ORDER[empty]
    source = np.arange(BINS)
    source[empty] = order[np.arange(len(empty)), full[order].argmax(1)]
    return hashes[first[source]]


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    return mixed((values * ODD).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _sketches(batches, words: int, seed: int):
    for batch in batches:
        n, one, two, keys = [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            hashes = np.unique(shingle_hashes(text or b"", words, seed))
            digest = xxhash.xxh3_128_digest(hashes.tobytes())
            a, b = np.frombuffer(digest, "<i8").tolist()
            n.append(len(hashes)), one.append(a), two.append(b)
            keys.append(band_keys(signature(hashes)).view(np.int64).tolist() if len(hashes) else None)
        made = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "_a", "_b")] + made, names=["doc_id", "_a", "_b", "n", "d1", "d2", "keys"])


def sketches(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text. doc_id, _a, _b (two hashes of the text), n (shingles), d1, d2 (a digest of the set), keys (of bands)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return hashed(docs).mapInArrow(partial(_sketches, words=words, seed=seed), f"doc_id {kind}, _a long, _b long, n long, d1 long, d2 long, keys array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b"))


def _sets(batches, words: int, seed: int):
    for batch in batches:
        sets = [np.unique(shingle_hashes(x or b"", words, seed)).tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """wanted: node, first (doc_id, _a, _b of the text that stands for the class). node, shingles (eight bytes each)."""
    wanted = wanted.select("node", F.col("first._a").alias("_a"), F.col("first._b").alias("_b"), F.col("first.doc_id").alias("_id"))
    found = hashed(docs).join(wanted, ["_a", "_b"]).filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    return publish(found.dropDuplicates(["node"]).mapInArrow(partial(_sets, words=words, seed=seed), "node long, shingles binary"))


def numbers(shingles: bytes) -> np.ndarray:
    return np.frombuffer(shingles, "<u8")


def linked(a: np.ndarray, b: np.ndarray, per_cent: int = SIMILARITY) -> bool:
    """Whether two sets (sorted, not empty) are as similar as that."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < per_cent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _confirmed(batches, per_cent: int):
    """Rows of node, centre and both sets: those that are linked."""
    for batch in batches:
        node, centre, one, other = (batch.column(c).to_pylist() for c in ("node", "centre", "shingles", "other"))
        hit = [i for i in range(len(node)) if linked(numbers(one[i]), numbers(other[i]), per_cent)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in hit], pa.int64()) for x in (node, centre)], names=["src", "dst"])


def stars(met: DataFrame) -> DataFrame:
    """met: key, node, size. Candidates node, centre: each class of a bucket with the smallest, once for all buckets,
    if their sizes don't rule it out."""
    centres = met.groupBy("key").agg(F.min(F.struct("node", "size")).alias("centre"), F.count("*").alias("m"))
    pairs = join_by_size(met, publish(centres), ["key"], "m", "inner").filter("node <> centre.node")
    fits = 100 * F.least("size", "centre.size") >= SIMILARITY * F.greatest("size", "centre.size")
    return publish(pairs.filter(fits).select("node", F.col("centre.node").alias("centre")).distinct())


def confirm(pairs: DataFrame, sets: DataFrame, per_cent: int = SIMILARITY) -> DataFrame:
    """Links (src, dst) among candidates. A centre of very many is copied to as many tasks as they need."""
    counts = publish(pairs.groupBy("centre").agg(F.count("*").alias("m")))
    centres = counts.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("other")), "centre")
    found = join_by_size(pairs.join(sets, "node"), publish(centres), ["centre"], "m", "inner")
    return publish(found.select("node", "centre", "shingles", "other").mapInArrow(partial(_confirmed, per_cent=per_cent), "src long, dst long"))


def with_parts(met: DataFrame, links: DataFrame) -> DataFrame:
    """met with part, the component of each class so far."""
    parts = connected_components(links).withColumnRenamed("component", "part")
    return met.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))


def unsettled(met: DataFrame, least: int) -> DataFrame:
    """met: key, node, size, part. Rows of the buckets of at least so many classes that are of several components, one of
    all buckets that have the same classes; with n, how many rows the bucket has, and bytes, of its sets together."""
    marks = F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)"))
    buckets = met.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi"), marks[0].alias("m1"), marks[1].alias("m2"))
    buckets = buckets.filter((F.col("n") >= least) & (F.col("lo") != F.col("hi"))).groupBy("n", "size", "m1", "m2").agg(F.min("key").alias("key")).select("key", "n", (8 * F.col("size")).alias("bytes"))
    return publish(join_by_size(met, publish(buckets), ["key"], "n", "inner").select("key", "node", "size", "part", "n", "bytes"))


def again(met: DataFrame, keys: DataFrame) -> DataFrame:
    """met: key, node, size, part; keys: node, keys. The rows dealt by each of their other bands too: linked ones still meet."""
    more = met.join(keys, "node").select("node", "size", "part", F.col("key").alias("was"), F.explode("keys").alias("more"))
    dealt = more.filter("was <> more").select(F.xxhash64("was", "more").alias("key"), "node", "size", "part")
    return dealt


def blocks(met: DataFrame, most: int) -> DataFrame:
    """met: key, node, size, part, bytes. Each bucket cut into blocks of about half of most bytes; two blocks are a bucket."""
    count = F.ceil(2 * F.col("bytes") / most).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit("block")), count).cast("int")
    cut = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    # the pair of a block with itself is within each pair that has it
    return cut.filter("mine <> other").select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", "size", "part")


def _compared(batches, per_cent: int):
    """Rows sorted by key: of each bucket links between classes of different parts, breadth first."""
    held: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "part", "shingles")), strict=True):
            if held and row[0] != held[0][0]:
                yield _within(held, per_cent)
                held = []
            held.append(row)
    if held:
        yield _within(held, per_cent)


class _Postings:
    """Which sets of a bucket hold a shingle, to count at once what one shares with each other."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
        self.at = np.searchsorted(number[order], np.arange(number.max() + 2))
        self.of = np.split(number, np.cumsum([len(x) for x in sets])[:-1])

    def shared(self, i: int) -> np.ndarray:
        return np.bincount(np.concatenate([self.owner[self.at[g] : self.at[g + 1]] for g in self.of[i]]), minlength=len(self.of))


#: Buckets of more classes than that count what sets share by postings.
FEW = 16


def _within(bucket: list[tuple], per_cent: int) -> pa.RecordBatch:
    node, sets = [x[1] for x in bucket], [numbers(x[3]) for x in bucket]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    part = np.unique(np.array([x[2] for x in bucket], np.int64), return_inverse=True)[1]
    postings = _Postings(sets) if len(bucket) > FEW else None
    src, dst = [], []
    for i in range(len(bucket) - 1):
        fits = (part != part[i]) & (100 * np.minimum(sizes, sizes[i]) >= per_cent * np.maximum(sizes, sizes[i]))
        others = np.flatnonzero(fits[i + 1 :]) + i + 1
        if postings and len(others) > FEW:
            both = postings.shared(i)[others]
            others = others[100 * both >= per_cent * (sizes[i] + sizes[others] - both)]
        else:
            others = [j for j in others if linked(sets[i], sets[j], per_cent)]
        for j in others:
            if part[j] != part[i]:
                src.append(node[i]), dst.append(node[j])
                part[part == part[j]] = part[i]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (src, dst)], names=["src", "dst"])


def compare(met: DataFrame, sets: DataFrame, per_cent: int = SIMILARITY) -> DataFrame:
    small_batches(met.sparkSession)
    rows = met.select("key", "node", "part").join(sets, "node").repartition("key").sortWithinPartitions("key", "node")
    return publish(rows.mapInArrow(partial(_compared, per_cent=per_cent), "src long, dst long"))


def set_links(classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], crowd: int = CROWD, per_cent: int = SIMILARITY) -> DataFrame:
    """classes: node, n, keys; fetch(node): node and shingles of those. Links whose closure is that of all pairs of sets as
    similar as that."""
    dealt = classes.select("node", F.col("n").alias("size"), F.explode("keys").alias("key"))
    shared = publish(dealt.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    met = publish(join_by_size(dealt, shared, ["key"], "m", "inner").select("key", "node", "size"))
    pairs = stars(met)
    sets = fetch(pairs.select("node").unionAll(pairs.select("centre")).distinct())
    links = confirm(pairs, sets, per_cent)
    left = unsettled(with_parts(met, links), 3)  # of two, the star has compared both
    if left.isEmpty():
        return links
    large = left.filter(F.col("bytes") > crowd)
    ready = [left.filter(F.col("bytes") <= crowd).select("key", "node", "part")]
    if not large.isEmpty():
        dealt = unsettled(again(large, classes.select("node", "keys")), 2)
        ready += [dealt.filter(F.col("bytes") <= crowd).select("key", "node", "part"), blocks(dealt.filter(F.col("bytes") > crowd), crowd).select("key", "node", "part")]
    sets = fetch(left.select("node").distinct())
    return links.unionAll(compare(reduce(DataFrame.unionAll, ready), sets, per_cent))


def near_sets(docs: DataFrame, words: int = WORDS, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """docs: doc_id, text. One row a document: doc_id, n_shingles, component_id, kept."""
    shared_dir(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = publish(sketches(docs, words, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b"))
    same = found.filter("n > 0").groupBy("d1", "d2").agg(first.alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = publish(same.withColumn("node", F.monotonically_increasing_id()))
    firsts = classes.select("node", "first")
    parts = connected_components(set_links(classes.select("node", "n", "keys"), lambda wanted: sets_of(docs, firsts.join(wanted, "node"), words, seed), crowd))
    named = publish(classes.select("node", "d1", "d2", "rows", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    ids = publish(join_by_size(named, publish(ids), ["component"], "m", "inner").select("d1", "d2", "rows", "component_id"))
    rows = join_by_size(found.filter("n > 0").select("doc_id", "n", "d1", "d2"), ids, ["d1", "d2"], "rows", "inner").select("doc_id", "n", "component_id")
    rows = rows.unionAll(found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    return near_sets(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, near.b FROM reach r JOIN near ON near.a = r.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN part USING (doc_id)
"""
