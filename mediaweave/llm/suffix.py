"""9. Suffix-array dedup: removes each byte that a string of SPAN bytes covers which also starts anywhere else.

Every start of a SPAN-byte string (a window) is dealt by the smallest hash of the GRAM-byte grams inside it. Windows
of equal content share it, and neighbouring windows mostly do, so that a text becomes a few runs of windows a
hundred bytes. Runs whose smallest hash occurs once in the corpus, at one place, are done. Of the others equal runs
(by that hash and a 128-bit digest of their bytes) are counted as one, which is fetched once; the runs of a hash meet
in one task. There a block's suffixes are sorted in two stages: those smaller than their successors directly, the rest
induced by scanning the buckets of first bytes from low to high. Adjacent suffixes with a common prefix of SPAN bytes,
and runs that occur twice, are repeats.

A hash with over CROWD different runs or BYTES of them (a common line in many contexts) is dealt again by a second
hash. Parts that are equal byte for byte are then counted with map-side combining and only one of them goes on. The
last deal is by windows, where that count leaves nothing to sort: no key is ever one task's work.

Defined results: a null text is empty; a text of under SPAN bytes keeps all of them; repeated rows are repeats of
each other; a null doc_id is a value like any other; an empty table gives an empty result. A long text is cut into
runs of at most LONGEST windows; it has to fit a row. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import join_by_size, publish, small_batches, table

SPAN, GRAM = 200, 16
CROWD, BYTES, LEVELS = 5000, 4_000_000, 4
LONGEST = 2000
BLOCK = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int, level: int) -> np.ndarray:
    """A hash of the gram (a power of two) that starts at each byte."""
    h = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * level))[data]
    size, odd = 1, np.uint64(0x9E3779B97F4A7C15)
    while size < gram:
        h = h[:-size] * odd + h[size:]
        size, odd = 2 * size, np.uint64(int(odd) ** 2 % 2**64)
    return h ^ (h >> np.uint64(29))


PLACE = np.uint64(2**21 - 1)


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        h, have = np.minimum(h[:-step], h[step:]), have + step
    return h


def window_keys(data: np.ndarray, span: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the smallest of its grams' hashes (at the last level a hash of its own), and the places of the
    first and last gram that has it."""
    n = len(data) - span + 1
    at = np.arange(n, dtype=np.uint64)
    if level == LEVELS:
        whole = data.tobytes()
        return np.fromiter((xxhash.xxh3_64_intdigest(whole[i : i + span]) for i in range(n)), np.uint64, n), at, at
    gram = min(GRAM, 1 << (span.bit_length() - 1) >> 2)
    h, width = gram_hashes(data, gram, level), span - gram + 1
    place = np.arange(len(h), dtype=np.uint64) & PLACE  # in the low bits, so that of equal hashes one wins
    first = smallest((h & ~PLACE) | place, width)
    last = smallest((h & ~PLACE) | (PLACE - place), width)
    first = at + (((first & PLACE) - at) & PLACE)
    last = at + (((PLACE - (last & PLACE)) - at) & PLACE)
    return h[first.astype(np.int64)], first, last


def runs_of(texts: list[bytes], span: int, level: int = 0):
    """Runs of windows with one key: text number, first and last start, key, whether it may repeat itself."""
    at = 0
    while at < len(texts):
        chunk, size, first = [], 0, at
        while at < len(texts) and (not chunk or size + len(texts[at]) < BLOCK):
            chunk.append(texts[at])
            size, at = size + len(texts[at]), at + 1
        if size < span:
            continue
        lengths = np.fromiter(map(len, chunk), np.int64, len(chunk))
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        keys, left, right = window_keys(np.frombuffer(b"".join(chunk), np.uint8), span, level)
        windows = np.maximum(lengths - span + 1, 0)
        of = np.repeat(np.arange(len(chunk)), windows)
        start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = begin[of] + start
        keys = keys[place]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
        longest = 1 if level == LEVELS else LONGEST
        if len(new) and (sizes := np.diff(np.r_[new, len(of)])).max() > longest:
            new = np.flatnonzero((np.arange(len(of)) - np.repeat(new, sizes)) % longest == 0)
        last = np.r_[new[1:] - 1, len(of) - 1] if len(of) else new
        yield of[new] + first, start[new], start[last], keys[new], left[place[new]] != right[place[last]]


def _runs(batches, span: int, digest: bool):
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        for of, lo, hi, keys, own in runs_of(texts, span):
            arrays, names = [pa.array(keys.view(np.int64))], ["m"]
            if not digest:  # what may repeat itself counts twice
                arrays = [pa.array(np.concatenate([keys, keys[own]]).view(np.int64))]
            else:
                rest = [xxhash.xxh3_128_digest(texts[i][a : b + span]) for i, a, b in zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                arrays += [pa.array(rest, pa.binary()), batch.column("k").take(pa.array(of)), batch.column("h").take(pa.array(of)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                names += ["d", "k", "h", "lo", "hi"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _split(batches, span: int, level: int):
    """Segments of crowded keys, cut into runs by the next level's keys."""
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("key", "m", "d", "n", "off", "seg")}
        for of, lo, hi, keys, _ in runs_of(cols["seg"], span, level):
            of, lo, hi = of.tolist(), lo.tolist(), hi.tolist()
            key = mixed(keys + np.array([cols["key"][i] for i in of], np.int64).view(np.uint64)).view(np.int64)
            for at in range(0, len(of), 10_000):
                some = list(zip(of[at : at + 10_000], lo[at : at + 10_000], hi[at : at + 10_000], strict=True))
                arrays = [pa.array(key[at : at + 10_000]), *(pa.array([cols[c][i] for i, _, _ in some], t) for c, t in (("m", pa.int64()), ("d", pa.binary()), ("n", pa.int64())))]
                arrays += [pa.array([cols["off"][i] + a for i, a, _ in some], pa.int32()), pa.array([cols["seg"][i][a : b + span] for i, a, b in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "m", "d", "n", "off", "seg"])


def counted(parts: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Of parts that are equal byte for byte (under one key) all are repeats, and one goes on with the count of all."""
    same = publish(parts.groupBy("key", "seg").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min(F.struct("m", "d", "off")).alias("one")))
    often = same.filter("n > 1").select("key", "seg", "rows")
    repeats = join_by_size(parts.select("key", "seg", "m", "d", "off"), often, ["key", "seg"], "rows", "inner")
    repeats = repeats.select("m", "d", F.col("off").alias("first"), (F.col("off") + F.octet_length("seg") - span).alias("last"))
    return publish(repeats), same.select("key", "one.m", "one.d", "n", "one.off", "seg")


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, as a number; zeros follow the last one."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    return np.ascontiguousarray(np.ndarray(len(data), "<u8", padded.tobytes(), strides=(1,)))


#: For how many words in turn suffixes are sorted as numbers; what is equal then is sorted as strings.
WORDS = 4


def sort_directly(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by at most SPAN bytes within their segments: eight bytes first, the next
    eight among equals and so on."""
    words = words_at(data).byteswap()
    left = ends[at] - at
    masks = ~np.uint64(0) << np.array([64 - 8 * k if k else 63 for k in range(9)], np.uint64)
    masks[0] = 0
    tied, group = np.arange(len(at)), np.zeros(len(at), np.int64)  # places of the order that are still open
    for k in range(WORDS):
        if not len(tied):
            return at
        here, rest = at[tied], left[tied] - 8 * k
        keys = words[np.minimum(here + 8 * k, len(data) - 1)] & masks[np.clip(rest, 0, 8)]
        order = np.lexsort((keys, group)) if k else np.argsort(keys, kind="stable")
        at[tied], left[tied], keys, group = here[order], left[tied][order], keys[order], group[order]
        same = (keys[1:] == keys[:-1]) & (group[1:] == group[:-1])
        number = np.cumsum(np.r_[True, ~same]) if len(same) or len(tied) else group
        open_ = np.r_[False, same] | np.r_[same, False]
        tied, group = tied[open_], number[open_]
    if len(tied):
        here = at[tied]
        rows = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(SPAN, np.uint8)], SPAN)[here]
        for i in np.flatnonzero(left[tied] < SPAN).tolist():
            rows[i, left[tied[i]] :] = 0
        at[tied] = here[np.argsort(np.ascontiguousarray(rows).view(f"S{SPAN}").ravel(), kind="stable")]
    return at


def next_place(marks: np.ndarray) -> np.ndarray:
    """For each place the first marked one from it on; the last place counts as marked."""
    at = np.where(marks, np.arange(len(marks)), len(marks) - 1)
    return np.minimum.accumulate(at[::-1])[::-1]


def suffix_order(data: np.ndarray, ends: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Needed positions of a text of segments (ends: where each one's segment ends) in the order of their suffixes,
    which are compared up to their segment's end, at most SPAN bytes directly."""
    n = len(data)
    after = np.r_[data[1:], 0].astype(np.int16)
    after[np.arange(n) + 1 == ends] = -1  # a segment's end is smaller than any byte
    step = np.sign(after - data.astype(np.int16))
    at = np.arange(n)
    small = step[next_place(step != 0)] > 0  # smaller than its successor
    stops = next_place(small | (at + 1 == ends))
    needed = needed.copy()
    last = np.flatnonzero(needed & ~np.r_[needed[1:], False])
    for a, b in zip(last.tolist(), stops[last].tolist(), strict=True):
        needed[a : b + 1] = True  # what the last ones are induced from
    direct = sort_directly(data, ends, np.flatnonzero(needed & small))
    by_byte = np.searchsorted(data[direct], np.arange(257))
    induced = needed & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []

    def before(found: np.ndarray) -> np.ndarray:
        """The induced suffixes that are one byte longer, in the same segment."""
        found = found[found > 0] - 1
        return found[induced[found] & (ends[found] == ends[found + 1])]

    def wait(found: np.ndarray) -> None:
        """Hands suffixes on to the buckets of their first bytes, in their order."""
        found = found[np.argsort(data[found], kind="stable")]
        for part in np.split(found, np.flatnonzero(np.diff(data[found])) + 1) if len(found) else []:
            waiting[data[part[0]]].append(part)

    wait(np.flatnonzero(induced & (at + 1 == ends)))  # induced by the empty suffixes
    for c in range(256):
        bucket, front = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(front):
            bucket.append(front)
            front = before(front)
            front = front[data[front] == c]
        bucket.append(direct[by_byte[c] : by_byte[c + 1]])
        whole = np.concatenate(bucket)
        if len(whole):
            order.append(whole)
            longer = before(whole)
            wait(longer[data[longer] > c])
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Whether each position of the order and the next have span bytes in common."""
    words = words_at(data)
    same = np.arange(len(order) - 1)
    for at in [*range(0, span - 7, 8), span - 8]:
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[same] = True
    return out


def repeated_windows(segments: list[bytes], counts: list[int], span: int) -> list[np.ndarray]:
    """For each segment whether each of its windows occurs elsewhere."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    stop = np.cumsum(lengths)
    begin, data = stop - lengths, np.frombuffer(b"".join(segments), np.uint8)
    ends = np.repeat(stop, lengths)
    window = ends - np.arange(len(data)) >= span
    order = suffix_order(data, ends, window)
    order = order[window[order]]
    repeat = np.zeros(len(data), bool)
    pairs = np.flatnonzero(common_prefixes(data, order, span))
    repeat[order[pairs]] = repeat[order[pairs + 1]] = True
    return [np.ones(e - b - span + 1, bool) if n > 1 else repeat[b : e - span + 1] for b, e, n in zip(begin.tolist(), stop.tolist(), counts, strict=True)]


def _repeats(batches, span: int):
    """Segments come sorted by key; a block ends where a key does."""
    held: dict[str, list] = {c: [] for c in ("key", "m", "d", "n", "off", "seg")}
    size = 0
    for batch in batches:
        for c in held:
            held[c] += batch.column(c).to_pylist()
        size += sum(map(len, batch.column("seg").to_pylist()))
        if size > BLOCK:
            cut = next((i for i in range(len(held["key"]) - 1, 0, -1) if held["key"][i] != held["key"][i - 1]), 0)
            yield from _blocks({c: x[:cut] for c, x in held.items()}, span)
            held = {c: x[cut:] for c, x in held.items()}
            size = sum(map(len, held["seg"]))
    yield from _blocks(held, span)


def _blocks(rows: dict[str, list], span: int):
    at, n = 0, len(rows["key"])
    while at < n:
        to, size = at, 0
        while to < n and (size < BLOCK or rows["key"][to] == rows["key"][to - 1]):
            size, to = size + len(rows["seg"][to]), to + 1
        m, d, first, last = [], [], [], []
        for i, found in enumerate(repeated_windows(rows["seg"][at:to], rows["n"][at:to], span), at):
            edges = np.flatnonzero(np.diff(np.r_[False, found, False]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                m.append(rows["m"][i]), d.append(rows["d"][i]), first.append(rows["off"][i] + a), last.append(rows["off"][i] + b - 1)
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(d, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["m", "d", "first", "last"])
        at = to


def _merged(batches):
    """A run's repeated windows as few spans: those that touch are one."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict[str, int]] = []
            for x in sorted(spans, key=lambda x: (x["first"], x["last"])):
                if merged and x["first"] <= merged[-1]["last"] + 1:
                    merged[-1]["last"] = max(merged[-1]["last"], x["last"])
                else:
                    merged.append(x)
            out.append(merged)
        spans = pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("d"), batch.column("n"), spans], names=["m", "d", "n", "spans"])


RESULTS = "doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches, digest_only: bool):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text, kept, at, removed, n = text or b"", [], 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in spans or []):
                if s > at or not n:
                    n += 1
                    kept.append(text[at:s])
                    removed += e - s
                elif e > at:
                    removed += e - at
                at = max(at, e)
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), None if digest_only else kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, span: int = SPAN, crowd: int = CROWD, digest_only: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay, null with
    digest_only)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # rows with one doc_id and one text are equal in all that matters here, so the two name a text
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("k"), F.xxhash64("text").alias("h"), "text")
    sizes = publish(docs.groupBy("k", "h").count())
    texts = docs.select("k", "h", "text")
    if not sizes.filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["k", "h"])
    often = publish(docs.mapInArrow(partial(_runs, span=span, digest=False), "m long").groupBy("m").count().filter("count > 1"))
    runs = docs.mapInArrow(partial(_runs, span=span, digest=True), "m long, d binary, k long, h long, lo int, hi int")
    runs = publish(join_by_size(runs, often, ["m"], "count", "inner").drop("count"))
    one = runs.groupBy("m", "d").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "lo", "hi")).alias("at")).select("m", "d", "n", "at.*")
    part = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo") + span)
    segments = one.join(texts.hint("merge"), ["k", "h"]).select(F.col("m").alias("key"), "m", "d", "n", F.lit(0).alias("off"), part.alias("seg"))
    segments, found = publish(segments), []
    counts = segments.select("m", "d", "n")
    shape = "key long, m long, d binary, n long, off int, seg binary"
    for level in range(1, LEVELS + 1):
        large = (F.count("*") > crowd) | (F.sum(F.octet_length("seg")) > BYTES)
        crowded = publish(segments.groupBy("key").agg(F.count("*").alias("n_parts"), large.alias("large")).filter("large").select("key", "n_parts"))
        last = crowded.isEmpty()
        ready = segments if last else segments.join(crowded, "key", "left_anti")
        sorted_ = ready.repartition("key").sortWithinPartitions("key")
        found.append(publish(sorted_.mapInArrow(partial(_repeats, span=span), "m long, d binary, first int, last int")))
        if last:
            break
        again = join_by_size(segments, crowded, ["key"], "n_parts", "inner").select(*(x.split()[0] for x in shape.split(", ")))
        repeats, segments = counted(publish(again.mapInArrow(partial(_split, span=span, level=level), shape)), span)
        found.append(repeats)
    repeats = reduce(DataFrame.unionAll, found).groupBy("m", "d").agg(F.collect_set(F.struct("first", "last")).alias("spans")).join(counts, ["m", "d"])
    repeats = publish(repeats.mapInArrow(_merged, "m long, d binary, n long, spans array<struct<first int, last int>>"))
    spans = join_by_size(runs, repeats, ["m", "d"], "n", "inner").select("k", "h", "lo", F.explode("spans").alias("span"))
    spans = spans.select("k", "h", F.struct((F.col("lo") + F.col("span.first")).alias("s"), (F.col("lo") + F.col("span.last") + span).alias("e")).alias("span"))
    by_doc = publish(spans.groupBy("k", "h").agg(F.collect_set("span").alias("spans")).join(sizes, ["k", "h"]))
    cut = join_by_size(docs, by_doc, ["k", "h"], "count").select("doc_id", "text", "spans")
    return cut.mapInArrow(partial(_cut, digest_only=digest_only), RESULTS.format(kind))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True).drop("kept")
