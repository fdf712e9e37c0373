"""7. Benchmark decontamination by winnowing.

Of the K-grams of each window of WINDOW words the one with the smallest hash (the first of equal ones) is kept, which
leaves about two in seven; equal windows keep the same gram. Both sides keep such grams with the words around them that
windows with the gram can reach. They meet by the gram's hash, and a meeting extends over the words to both sides as
long as they agree: WINDOW words or more are a hit. So every shared span of WINDOW words is found, and hits are exact.

A gram that more than CROWDED contexts of the benchmark have (a common instruction) would meet too many of them: there the
contexts' windows meet by all their words instead. An item of fewer words is one window of its own length, met by all
its words too.

Both sides are Spark tables of any size. A bitmap of the benchmark's hashes goes to all tasks, so that only a document's
grams that may meet are shuffled; it has 128 bits a hash and 2 ** BITS at most (a full one only lets more into the join).
A gram or window that very many documents hold is dealt to many tasks. Items are looked up once for each different set of
contexts and windows that documents hit, not for each document or hit.

Defined results: a null text has no words; an item or document without words matches nothing; items with equal
words are all counted, an item_id that repeats once; repeated rows get equal results; empty tables give an empty
result or no contamination; a text of any length is read whole and has to fit a row. Other columns pass through
contamination(), whatever their names, but one that has the name of a result is replaced.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import join_by_size, packed, publish, small_batches, table, unpacked

WINDOW, K = 10, 5
#: The bitmap has 2 ** BITS bits at most.
BITS = 28
#: Contexts of the benchmark that a gram may have to be met one by one.
CROWDED = 16
#: Word hashes that a task remembers.
REMEMBERED = 500_000
#: Lower-cases A-Z and makes a space of what is no part of a word, in UTF-8.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words in a text that still has its A-Z.
WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Numbers(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def gram_hashes(numbers: np.ndarray, k: int) -> np.ndarray:
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, odd = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        h = (h ^ numbers[i : i + n]) * odd
        h ^= h >> np.uint64(29)
    return h


def winnowed(hashes: np.ndarray, grams: int) -> np.ndarray:
    """The places that hold the first smallest of any `grams` hashes in a row."""
    if len(hashes) < grams:
        return np.zeros(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(hashes, grams).argmin(axis=1) + np.arange(len(hashes) - grams + 1)
    return best[np.flatnonzero(np.diff(best, prepend=-1))]  # a later window's is never before an earlier one's


def _fingerprints(batches, carried: list[str], lengths: tuple[int, ...] | None, bitmap):
    """Winnowed grams with their hash h, and the words of all windows that can have them: at (number of the first word),
    lead (words before the gram), n (WINDOW), words. And short windows of n words: without lengths, the one of an item
    that is short; with lengths, a document's windows of these. Where there is a bitmap, only what it has."""
    known, reach = Numbers(), WINDOW - K
    bits = np.frombuffer(bitmap.value, np.uint64) if bitmap else None
    for batch in batches:
        of, hashes, places, leads, sizes, texts = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words = words_of(text)
            numbers = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            short = lengths if lengths is not None else (len(words),) if 0 < len(words) < WINDOW else ()
            for n in (WINDOW, *short):
                h = gram_hashes(numbers, K if n == WINDOW else n)
                at = winnowed(h, reach + 1) if n == WINDOW else np.arange(len(h))
                if bits is not None:
                    x = h[at]
                    at = at[np.flatnonzero(bits[(x >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (x & np.uint64(63)) & np.uint64(1))]
                for p, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True):
                    start, end = (max(0, p - reach), p + WINDOW) if n == WINDOW else (p, p + n)
                    of.append(i), hashes.append(x), places.append(start), leads.append(p - start), sizes.append(n), texts.append(b" ".join(words[start:end]))
        arrays = [pa.array(x, pa.int64()) for x in (hashes, places, leads, sizes)] + [pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of, pa.int64())) for c in carried), *arrays], names=[*carried, *NAMES])


NAMES = ("h", "at", "lead", "n", "words")
SHAPE = "h long, at long, lead long, n long, words string"


def whole_windows(rows: DataFrame) -> DataFrame:
    """Fingerprints' contexts as the windows in them: at, n and words are each window's. Short windows stay."""
    words = F.split("words", " ")
    starts = F.when(F.col("n") < WINDOW, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (F.size(words) - WINDOW).cast("long")))
    rows = rows.withColumn("_start", F.explode(starts)).withColumn("words", F.array_join(F.slice(words, F.col("_start").cast("int") + 1, F.col("n").cast("int")), " "))
    return rows.withColumn("at", F.col("at") + F.col("_start")).drop("_start", "lead")


def agreeing(one, other):
    """How many words two arrays have in common from their start."""
    differs = F.array_position(F.zip_with(one, other, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(one))


def extended(met: DataFrame) -> DataFrame:
    """met: a document's at, lead and words, an item's item_lead and item_words. Adds from and to, the words around the gram
    that agree, of those meetings in which the gram itself and WINDOW words agree."""
    sides = [(F.split(words, " "), F.col(lead).cast("int")) for words, lead in (("words", "lead"), ("item_words", "item_lead"))]
    before = agreeing(*(F.reverse(F.slice(w, 1, lead)) for w, lead in sides))
    after = agreeing(*(F.slice(w, lead + 1, WINDOW) for w, lead in sides))
    met = met.withColumns({"_before": before, "_after": after}).filter((F.col("_after") >= K) & (F.col("_before") + F.col("_after") >= WINDOW))
    gram = F.col("at") + F.col("lead")
    return met.withColumns({"from": gram - F.col("_before"), "to": gram + F.col("_after")}).drop("_before", "_after")


def fingerprint_bitmap(windows: DataFrame, most: int) -> bytes:
    """Bits for hashes, 128 a hash and 2 ** most at most; the driver gets at most 2 ** (most - 6) rows."""
    bits = min(most, max(16, (128 * windows.count()).bit_length()))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(2 ** (bits - 6) - 1))
    rows = windows.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(2 ** (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out.tobytes()


def covered(spans):
    """How many places sorted spans cover."""
    zero = F.lit(0).cast("long")

    def add(so_far, x):
        new = F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], so_far["upto"]))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(so_far["upto"], x["end"]).alias("upto"))

    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("upto")), add)["n"]


def item_lists(by_doc: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """by_doc: targets, what a document hits. Each different list of targets once, with n_items and items_sha256 of the items
    that have one of them, and rows, how many documents have the list. The digest needs a list's items in one row."""
    sets = publish(by_doc.groupBy("targets").agg(F.count("*").alias("rows")).withColumn("of", F.monotonically_increasing_id()))
    named = publish(sets.select("of", F.explode("targets").alias("target")))
    uses = publish(targets.join(named.groupBy("target").agg(F.count("*").alias("uses")), "target"))
    ids = publish(members.join(uses, ["h", "lead", "words"]).select("item_id", "target", "uses"))
    lists = join_by_size(named, ids, ["target"], "uses", "inner").select("of", "item_id").distinct()
    lists = lists.groupBy("of").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    digests = lists.select("of", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    return sets.join(digests, "of").drop("of")


def contamination(docs: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Adds n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in docs.columns if c not in RESULTS]
    # rows with one doc_id and one text are equal in all that matters here, so the two name a document
    docs = packed(docs, "doc_id", "text").withColumns({"_k": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_h": F.xxhash64("text")})
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    items = items.mapInArrow(partial(_fingerprints, carried=["item_id"], lengths=None, bitmap=None), f"item_id string, {SHAPE}").drop("at")
    items = publish(items.distinct())
    crowded = items.filter(F.col("n") == WINDOW).select("h", "lead", "words").distinct().groupBy("h").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > CROWDED)
    items = publish(items.join(crowded, "h", "left").withColumn("crowded", F.col("contexts").isNotNull() & (F.col("n") == WINDOW)).drop("contexts"))
    by_words = (F.col("n") < WINDOW) | F.col("crowded")
    windows = whole_windows(items.filter(by_words).withColumn("at", F.lit(0).cast("long"))).select("item_id", "h", F.lit(-1).cast("long").alias("lead"), "words")
    # what documents may meet: a gram with a context, or (lead -1) a hash with a whole window
    members = publish(items.filter(~by_words).select("item_id", "h", "lead", "words").unionAll(windows).distinct())
    targets = publish(members.select("h", "lead", "words").distinct().withColumn("target", F.monotonically_increasing_id()))
    short = tuple(sorted(r["n"] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect()))  # WINDOW - 1 at most
    bitmap = spark.sparkContext.broadcast(fingerprint_bitmap(targets.select("h").distinct(), bits))
    found = docs.select("_k", "_h", "text").mapInArrow(partial(_fingerprints, carried=["_k", "_h"], lengths=short, bitmap=bitmap), f"_k string, _h long, {SHAPE}")
    found = publish(found.groupBy("_k", "_h", *NAMES).agg(F.count("*").alias("copies")))
    grams, wholes = targets.filter("lead >= 0"), targets.filter("lead < 0").drop("lead")
    # a row a gram: its contexts, CROWDED at most, and how many fingerprints of documents have it
    asked = found.filter(F.col("n") == WINDOW).groupBy("h").agg(F.count("*").alias("rows"))
    contexts = grams.groupBy("h").agg(F.collect_list(F.struct("target", F.col("lead").alias("item_lead"), F.col("words").alias("item_words"))).alias("contexts"))
    met = join_by_size(found.filter(F.col("n") == WINDOW), publish(contexts.join(asked, "h")), ["h"], "rows", "inner")
    hits = extended(met.select("_k", "_h", "copies", "at", "lead", "words", F.inline("contexts"))).select("_k", "_h", "copies", "from", "to", "target")
    # short windows, and all windows of the contexts of crowded grams, meet by their words
    hashes = publish(wholes.groupBy("h").agg(F.count("*").alias("wholes")).join(found.groupBy("h").agg(F.count("*").alias("rows")), "h"))
    open_ = whole_windows(join_by_size(found, hashes.drop("wholes"), ["h"], "rows", "inner")).select("_k", "_h", "copies", "h", "words", "at", "n")
    open_ = publish(open_)
    wanted = publish(wholes.join(open_.groupBy("h", "words").agg(F.count("*").alias("rows")), ["h", "words"]))
    whole = join_by_size(open_, wanted, ["h", "words"], "rows", "inner").select("_k", "_h", "copies", F.col("at").alias("from"), (F.col("at") + F.col("n")).alias("to"), "target")
    spans = F.array_sort(F.collect_set(F.struct(F.col("from").alias("at"), F.col("to").alias("end"))))
    by_doc = hits.unionAll(whole).groupBy("_k", "_h").agg(F.max("copies").alias("copies"), covered(spans).alias("n_hit"), F.array_sort(F.collect_set("target")).alias("targets"))
    by_doc = publish(by_doc)
    by_doc = join_by_size(by_doc, publish(item_lists(by_doc, members, targets)), ["targets"], "rows", "inner", hint=None)
    by_doc = publish(by_doc.select("_k", "_h", "copies", "n_hit", "n_items", "items_sha256"))
    docs = docs.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    none = F.lit(0).cast("long")
    results = ["n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")]
    return join_by_size(docs, by_doc, ["_k", "_h"], "copies", hint=None).select(*unpacked(columns, "doc_id", "text"), *results)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, n, i FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.x, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN t ON t.r = d.r
"""
