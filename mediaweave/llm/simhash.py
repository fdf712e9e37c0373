"""3. SimHash near-dedup with bit-sliced comparison.

A fingerprint's bits are the majority of its shingles' XXH64 bits. Equal fingerprints are one. Two that differ in
at most RADIUS bits agree in one of RADIUS + 1 bands of bits, so each is dealt to RADIUS + 1 buckets and compared
with the others of its buckets. A bucket with over CROWD fingerprints is dealt again by bands of the bits that its
key leaves free, until it is small or few bits are free, which bounds it. In a bucket the fingerprints are stored
as bit planes, 64 to a word; carry-save counters add up a plane's differences for a whole tile at once, and a tile
is given up as soon as all its distances are above the radius. A bucket returns stars, not pairs.

Defined results: a null text, like one without words, has fingerprint 0, which links like any other; a null doc_id
counts in no component's smallest doc_id (a component with no other has null); repeated rows share a fingerprint;
an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import copied_if_small, join_by_size, packed, publish, shared_dir, small_batches, table, unpacked
from mediaweave.operators.components import connected_components

BITS, RADIUS = 64, 2
CROWD = 4096
#: A bucket whose key leaves no more bits than that free is not dealt again; it has at most 2 ** FREE fingerprints.
FREE = 14
TILE = 256


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle in turn; a text of fewer words is one shingle, one without words has none."""
    parts = text.lower().split()  # of bytes: both know ASCII only
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Each bit as most of the hashes have it, as a signed number; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int, seed: int) -> int:
    return majority(shingle_hashes(text, words, seed))


def _fingerprints(batches, words: int, seed: int):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        prints = pa.array([fingerprint(x or b"", words, seed) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), prints], names=["doc_id", "_row", "fp"])


def with_fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, _row (a number of its own) and fp (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_fingerprints, words=words, seed=seed), f"doc_id {kind}, _row long, fp long")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit i of a word of plane b is bit b of fingerprint i."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.vstack([bits, np.zeros((-len(bits) % 64, BITS), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near_bits(tile: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(tile, words): bit i of a word tells whether fingerprint i of the planes is within the radius."""
    wanted = (tile[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    flip = np.uint64(0) - wanted  # all ones where the bit is set
    over = np.zeros((len(tile), planes.shape[1]), np.uint64)
    counter = [over.copy() for _ in range(radius.bit_length())]  # bit by bit, of 64 distances a word
    for b in range(BITS):
        carry = planes[b] ^ flip[:, b, None]
        for k, digit in enumerate(counter):
            counter[k], carry = digit ^ carry, digit & carry
        over |= carry
        if b % 8 == 7:
            far, equal = over.copy(), ~over
            for k in range(len(counter) - 1, -1, -1):
                if not radius >> k & 1:
                    far |= equal & counter[k]
                equal &= counter[k] if radius >> k & 1 else ~counter[k]
            if (far == ~np.uint64(0)).all():
                break
    return ~far


def roots(prints: np.ndarray) -> np.ndarray:
    """For each of a bucket's fingerprints the index of one that stands for all it reaches in the bucket."""
    n = len(prints)
    root, planes = np.arange(n), planes_of(prints)
    for at in range(0, n, TILE):
        near = near_bits(prints[at : at + TILE], planes)
        rows, words = np.nonzero(near)
        bits = np.unpackbits(near[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(bits)
        i, j = rows[pair] + at, words[pair] * 64 + bit
        i, j = i[inside := (j < n) & (i != j)], j[inside]
        while len(i):
            a, b = root[i], root[j]
            if not (apart := a != b).any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where the buckets of sorted rows start."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])]) if len(keys[0]) else np.zeros(0, np.int64)


def _arrays(batches, names: list[str], keys: int):
    """Columns of rows that come sorted by the first `keys` of them, cut only where a bucket ends."""
    left: list = []
    for batch in batches:
        left.append([batch.column(c).to_numpy() for c in names])
        columns = [np.concatenate(x) for x in zip(*left, strict=True)]
        starts = _starts(columns[:keys])
        cut = starts[-1] if len(starts) else 0
        if cut:
            yield [x[:cut] for x in columns]
        left = [[x[cut:] for x in columns]]
    if left and len(left[0][0]):
        yield left[0]


#: Buckets of so few fingerprints are compared together.
SMALL = 8


def near_in_small(starts: np.ndarray, ends: np.ndarray, prints: np.ndarray, radius: int):
    """The few pairs of small buckets, vertically as well: one word holds 64 of them. Yields the places of those that are near."""
    small = np.repeat(ends - starts <= SMALL, ends - starts)
    bucket = np.repeat(np.arange(len(starts)), ends - starts)
    for step in range(1, SMALL):
        i = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[step:])
        for at in range(0, len(i), 65536):
            k = i[at : at + 65536]
            words = near_bits(np.zeros(1, np.uint64), planes_of(prints[k] ^ prints[k + step]), radius)
            hit = k[np.unpackbits(words.view(np.uint8), bitorder="little")[: len(k)].astype(bool)]
            yield hit, hit + step


def _links(batches):
    """Rows come sorted by bucket. Links of the fingerprints of each."""
    for path, key, fp in _arrays(batches, ["path", "key", "fp"], 2):
        starts, prints = _starts([path, key]), fp.view(np.uint64)
        ends = np.r_[starts[1:], len(fp)]
        src, dst = [], []
        for s, e in zip(starts[large := ends - starts > SMALL], ends[large], strict=True):
            root = roots(prints[s:e])
            linked = np.flatnonzero(root != np.arange(e - s))
            src.append(fp[s:e][linked]), dst.append(fp[s:e][root[linked]])
        for one, other in near_in_small(starts, ends, prints, RADIUS):
            src.append(fp[other]), dst.append(fp[one])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def bands(free: list[int], radius: int = RADIUS) -> list[list[int]]:
    """The free bits in radius + 1 bands."""
    return [list(x) for x in np.array_split(free, radius + 1)]


def signed(bits: list[int]) -> int:
    return int(np.array([sum(1 << int(b) for b in bits)], np.uint64).view(np.int64)[0])


def fingerprint_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """prints: fp, distinct. Links (src, dst) whose closure joins exactly the fingerprints that the radius joins."""
    state, masks, out = prints.select("fp", F.lit(0).alias("parent")), {0: []}, []
    while True:
        paths = [(parent, parent * 3 + i + 1, used + band) for parent, used in masks.items() for i, band in enumerate(bands([b for b in range(BITS) if b not in used]))]
        by_parent = {parent: [F.struct(F.lit(path).alias("path"), F.lit(signed(used)).alias("mask")) for p, path, used in paths if p == parent] for parent in masks}
        deal = F.lit(None)
        for parent, to in by_parent.items():
            deal = F.when(F.col("parent") == parent, F.array(*to)).otherwise(deal)
        dealt = state.select("fp", F.explode(deal).alias("to")).select("fp", "to.path", F.col("fp").bitwiseAND(F.col("to.mask")).alias("key"))
        open_ = {path: used for _, path, used in paths if BITS - len(used) > FREE}
        crowded = publish(dealt.filter(F.col("path").isin(list(open_))).groupBy("path", "key").count().filter(F.col("count") > crowd).select("path", "key")) if open_ else None
        ready = dealt.join(crowded, ["path", "key"], "left_anti") if open_ else dealt
        out.append(publish(ready.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(_links, "src long, dst long")))
        if not open_ or crowded.isEmpty():
            break
        state = dealt.join(crowded, ["path", "key"], "left_semi").select("fp", F.col("path").alias("parent")).distinct()
        state, masks = publish(state), open_
    links = out[0]
    for more in out[1:]:
        links = links.unionAll(more)
    return links


def near_components(docs: DataFrame, words: int = 3, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """docs: doc_id, text. One row a document: doc_id, fp, component_id, stays (true for one row of a component, with
    the smallest doc_id)."""
    shared_dir(docs.sparkSession)
    found = publish(with_fingerprints(docs, words, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    prints = publish(found.groupBy("fp").agg(first.alias("least"), F.count("*").alias("rows")))
    parts = connected_components(fingerprint_links(prints.select("fp"), crowd))
    named = prints.join(parts, prints.fp == parts.node, "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    ids = publish(named.select("fp", "rows", "component").join(least, "component").select("fp", "rows", F.col("least.doc_id").alias("component_id"), F.col("least._row").alias("_first")))
    return join_by_size(found, ids, ["fp"], "rows", "inner").select("doc_id", "fp", "component_id", (F.col("_row") == F.col("_first")).alias("stays"))


#: For near_distinct(): the smallest shingle hashes that a document is dealt by, and the SimHash filter's radius.
#: Two documents with a similarity of 0.8 share none of eight, or differ in more bits, once in 10 ** 5 pairs.
MINIMA, WIDE = 8, 24
#: The smallest hashes in their own order deal all documents, those in another order what is crowded.
ORDERS = ("minima", "second")
#: A key that more documents have is crowded: CENTRES of them are compared with all others first.
CROWDED, CENTRES = 4096, 4


def in_orders(hashes: np.ndarray) -> list[np.ndarray]:
    """The MINIMA smallest of sorted hashes, in their own order and in others (each maps hashes one to one)."""
    out, odd = [hashes[:MINIMA]], np.uint64(0x9E3779B97F4A7C15)
    while len(out) < len(ORDERS):
        hashes = np.sort((hashes ^ (hashes >> np.uint64(32))) * odd)
        out.append(hashes[:MINIMA])
    return out


def _sketches(batches, words: int, seed: int):
    """Of each text the fingerprint, the smallest hashes in each order and the set of shingles (32 bits of each hash)."""
    for batch in batches:
        prints, minima, sets = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            hashes = np.unique(shingle_hashes(text or b"", words, seed))  # sets are compared: repeats must not weigh
            prints.append(majority(hashes))
            minima.append([x.view(np.int64).tolist() for x in in_orders(hashes)])
            sets.append(np.unique(hashes.astype(np.uint32)).tobytes())
        lists = [pa.array([x[k] for x in minima], pa.list_(pa.int64())) for k in range(len(ORDERS))]
        arrays = [batch.column("_k"), batch.column("_h"), pa.array(prints, pa.int64()), *lists, pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["_k", "_h", "fp", *ORDERS, "shingles"])


def _groups(batches, names: list[str]):
    """Rows of each key in turn, of batches sorted by it: lists of tuples, the key first."""
    held: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _with_partner(batches):
    """Of each bucket the documents whose fingerprint is near that of another."""
    for key, row, fp in _arrays(batches, ["key", "_row", "fp"], 1):
        starts, prints, near = _starts([key]), fp.view(np.uint64), np.zeros(len(fp), bool)
        ends = np.r_[starts[1:], len(fp)]
        for s, e in zip(starts[large := ends - starts > SMALL], ends[large], strict=True):
            planes = planes_of(prints[s:e])
            for at in range(s, e, TILE):
                bits = near_bits(prints[at : min(at + TILE, e)], planes, WIDE)
                near[at : at + len(bits)] = np.bitwise_count(bits & _valid(e - s)).sum(1) > 1
        for one, other in near_in_small(starts, ends, prints, WIDE):
            near[one] = near[other] = True
        yield pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(row[near])], names=["key", "_row"])


def _valid(n: int) -> np.ndarray:
    return np.packbits(np.arange(-(-n // 64) * 64) < n, bitorder="little").view("<u8")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if not len(a):
        return False  # texts without words link to nothing
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both >= least * (len(a) + len(b) - both)


def _pairs(pairs: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in range(2)], names=names)


def _similar_links(batches, least: float):
    for bucket in _groups(batches, ["key", "_row", "fp", "shingles"]):
        if stars := _stars(bucket, least):
            yield _pairs(stars, ["src", "dst"])


def _near_centres(batches, least: float):
    """Rows with the centres of their key: to which of them each is similar."""
    for batch in batches:
        key, n, row, shingles, centres = (batch.column(c).to_pylist() for c in ("key", "n", "_row", "shingles", "centres"))
        held = [(i, c["row"]) for i, cs in enumerate(centres) for c in cs if similar(np.frombuffer(shingles[i], np.uint32), np.frombuffer(c["shingles"], np.uint32), least)]
        arrays = [pa.array([x[i] for i, _ in held], pa.int64()) for x in (key, n, row)] + [pa.array([c for _, c in held], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "_row", "centre"])


#: A bucket with more shingles than that compares its documents one by one instead of by postings.
POSTINGS = 4_000_000
#: So few documents are compared one by one in any case.
FEW = 64


class _Overlaps:
    """How many shingles a document of a bucket shares with each other one, by postings."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n, self.sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
        _, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.r_[0, np.cumsum(self.sizes)]
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(self.number, kind="stable")
        self.postings, self.at = owner[order], np.searchsorted(self.number[order], np.arange(self.number.max(initial=-1) + 2))

    def similar(self, one: int, others: np.ndarray, least: float) -> np.ndarray:
        mine = self.number[self.start[one] : self.start[one + 1]]
        both = np.bincount(np.concatenate([self.postings[self.at[g] : self.at[g + 1]] for g in mine]), minlength=self.n)[others]
        return others[both >= least * (self.sizes[one] + self.sizes[others] - both)]


def _stars(bucket: list[tuple], least: float) -> list[tuple[int, int]]:
    """A bucket's documents, breadth first: each is compared once, with those not yet reached. Returns stars."""
    rows, prints = [x[1] for x in bucket], np.array([x[2] for x in bucket], np.int64).view(np.uint64)
    sets = [np.frombuffer(x[3], np.uint32) for x in bucket]
    many = len(bucket) > FEW
    overlaps = _Overlaps(sets) if many and sum(map(len, sets)) <= POSTINGS else None
    out, planes, apart = [], planes_of(prints) if many else None, np.ones(len(bucket), bool)
    tiles: dict[int, np.ndarray] = {}  # of the rows that are asked for, all of a tile at once
    for first in range(len(bucket)):
        if not apart[first]:
            continue
        apart[first], reached = False, [first]
        while reached and apart.any():
            one = reached.pop()
            others = np.flatnonzero(apart)
            if len(others) > FEW:
                tile, at = divmod(one, TILE)
                if tile not in tiles:
                    tiles[tile] = near_bits(prints[tile * TILE : (tile + 1) * TILE], planes, WIDE)
                near = np.unpackbits(tiles[tile][at].view(np.uint8), bitorder="little")[: len(bucket)].astype(bool)
                others = others[near[others]]
            else:
                others = others[np.bitwise_count(prints[others] ^ prints[one]) <= WIDE]
            if not len(others):
                continue
            linked = overlaps.similar(one, others, least) if overlaps and len(others) > FEW else [k for k in others if similar(sets[one], sets[k], least)]
            out += [(rows[k], rows[first]) for k in linked]
            reached += list(linked)
            apart[linked] = False
    return out


def without_stars(met: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """met: _row, key, n, the rows of crowded keys; sets: _row, shingles. Some rows of each key, its centres, are compared
    with all others. Returns the links found (src, dst), and the rows of the keys that not all belong to one star, with
    `loose`: whether the row is out of its key's largest star. That star's links join its rows already.
    Rows that are few are copied to the sets: all of these, which are large, would be shuffled for the few that are wanted."""
    picked = met.groupBy("key").agg(F.first("n").alias("n"), F.array_distinct(F.array(*(F.min_by("_row", F.xxhash64("_row", F.lit(i))) for i in range(CENTRES)))).alias("rows"))
    picked = copied_if_small(publish(picked.select("key", "n", F.explode("rows").alias("_row"))), 64).join(sets, "_row")
    centres = publish(picked.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct(F.col("_row").alias("row"), "shingles")).alias("centres")))  # CENTRES at most
    compared = join_by_size(copied_if_small(met.select("_row", "key"), 64).join(sets, "_row"), centres, ["key"], "n", "inner").select("key", "n", "_row", "shingles", "centres")
    near = publish(compared.mapInArrow(partial(_near_centres, least=least), "key long, n long, _row long, centre long"))
    best = near.groupBy("key", "n", "centre").agg(F.count("*").alias("size")).groupBy("key", "n").agg(F.max_by("centre", F.struct("size", "centre")).alias("centre"), F.max("size").alias("size"))
    mixed = publish(best.filter("size < n"))
    links = near.select(F.col("_row").alias("src"), F.col("centre").alias("dst")).filter("src != dst")
    star = join_by_size(near.drop("n"), mixed.drop("n"), ["key", "centre"], "size", "inner").select("key", "_row", F.lit(False).alias("loose"))
    rest = join_by_size(met.select("_row", "key"), mixed.select("key", "n"), ["key"], "n", "inner").select("_row", "key")
    return links, publish(rest.join(star, ["key", "_row"], "left").select("_row", "key", F.coalesce("loose", F.lit(True)).alias("loose")))


def block_pairs(met: DataFrame, crowd: int) -> DataFrame:
    """met: _row, key, loose, n, o (how many rows of the key are loose). A key's rows are cut into blocks of half a crowd;
    each pair of blocks is a bucket of its own, but not pairs of blocks of the star."""
    half = max(crowd // 2, 1)
    own, star = F.ceil(F.col("o") / half).cast("long"), F.ceil((F.col("n") - F.col("o")) / half).cast("long")
    mine = F.pmod(F.xxhash64("_row", F.lit("block")), F.when(F.col("loose"), own).otherwise(star))
    cut = met.select("_row", "key", "loose", own.alias("own"), star.alias("star"), mine.alias("mine"))
    others = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_loose = cut.select("*", F.explode(others(F.col("own"))).alias("other"))
    own_key = F.when(F.col("loose"), F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.xxhash64("key", F.lit("star"), "other", "mine"))
    with_star = cut.filter("loose AND star > 0").select("*", F.explode(others(F.col("star"))).alias("other"))
    return with_loose.select("_row", own_key.alias("key")).unionAll(with_star.select("_row", F.xxhash64("key", F.lit("star"), "mine", "other").alias("key")))


def meeting(dealt: DataFrame) -> DataFrame:
    """dealt: _row, key, loose. The rows of keys that have a loose row and another, with n (rows of the key) and o (loose ones)."""
    counts = publish(dealt.groupBy("key").agg(F.count("*").alias("n"), F.count_if("loose").alias("o")).filter("n > 1 AND o > 0"))
    return publish(join_by_size(dealt, counts, ["key"], "n", "inner").select("_row", "key", "loose", "n", "o"))


def shared_keys(sketches: DataFrame, crowd: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """sketches: _row, ORDERS, shingles. Rows and the keys of the buckets where they may meet similar ones (_row, key),
    and links that are already found.

    Documents are dealt by each of their smallest shingle hashes; keys that only one has go. The rows of a key with over
    crowd documents, as of a common line or of a large group of copies, are compared with some of its rows first: the
    rows of the largest star that this makes are linked. A key that has rows besides is dealt again by the smallest hashes
    in another order: each row has one there, so that none is lost, and similar ones share one as surely as before.
    What is crowded still is cut into blocks: each pair of blocks is a bucket, but those of the star among themselves."""
    small, large = F.col("n") <= crowd, F.col("n") > crowd
    met = meeting(sketches.select("_row", F.explode(ORDERS[0]).alias("key"), F.lit(True).alias("loose")))
    ready = [met.filter(small).select("_row", "key")]
    if met.filter(large).isEmpty():
        return ready[0], []
    links, rest = without_stars(met.filter(large), sketches.select("_row", "shingles"), least)
    again = copied_if_small(rest, 64).join(sketches.select("_row", ORDERS[1]), "_row").select("_row", "key", "loose", F.explode(ORDERS[1]).alias("more"))
    met = meeting(publish(again.select("_row", F.xxhash64("key", "more").alias("key"), "loose")))
    ready += [met.filter(small).select("_row", "key"), block_pairs(met.filter(large), crowd)]
    return reduce(DataFrame.unionAll, ready), [links]


def near_links(sketches: DataFrame, similarity: float, crowd: int = CROWDED) -> DataFrame:
    """sketches: _row, fp, ORDERS, shingles. Links (src, dst) of rows whose closure joins what that similarity joins."""
    keys, links = shared_keys(sketches, crowd, similarity)
    buckets = keys.join(sketches.select("_row", "fp"), "_row").repartition("key").sortWithinPartitions("key", "_row")
    wanted = publish(buckets.select("key", "_row", "fp").mapInArrow(_with_partner, "key long, _row long"))
    sets = copied_if_small(wanted, 64).join(sketches.select("_row", "fp", "shingles"), "_row").repartition("key").sortWithinPartitions("key", "_row")
    links.append(publish(sets.select("key", "_row", "fp", "shingles").mapInArrow(partial(_similar_links, least=similarity), "src long, dst long")))
    return reduce(DataFrame.unionAll, links)


def near_distinct(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, crowd: int = CROWDED) -> DataFrame:
    """docs: doc_id, text. Of each group that links of that Jaccard similarity of word shingles make, the row with the
    smallest doc_id; all rows that link to nothing. SimHash with the bit-sliced comparison filters the pairs of a bucket,
    the shingles themselves decide. Documents without words stay; rows that repeat doc_id and text stay or go together.
    Other columns are carried, whatever their names."""
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    columns = docs.columns
    docs = packed(docs, "doc_id", "text").withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_h": F.xxhash64("text")})
    shape = "_k long, _h long, fp long, " + ", ".join(f"{x} array<long>" for x in ORDERS) + ", shingles binary"
    found = docs.select("_k", "_h", "text").mapInArrow(partial(_sketches, words=words, seed=seed), shape)
    sketches = publish(found.withColumn("_row", F.monotonically_increasing_id()))
    parts = publish(connected_components(near_links(sketches, similarity, crowd)))
    members = sketches.select("_row", "_k", "_h").join(parts.withColumnRenamed("node", "_row"), "_row")
    least = members.groupBy("component").agg(F.min(F.struct("_k", "_h")).alias("least"), F.count("*").alias("size"))
    gone = publish(join_by_size(members, publish(least), ["component"], "size", "inner").filter(F.struct("_k", "_h") != F.col("least")).groupBy("_k", "_h").count())
    small = copied_if_small(gone, 64)
    left = docs.join(small, ["_k", "_h"], "left_anti") if small is not gone else join_by_size(docs, gone, ["_k", "_h"], "count", "left_anti")
    return left.select(*unpacked(columns, "doc_id", "text"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
