"""1. Mixing sources to target weights, with DataFrame functions only.

Sources get targets by capped water-filling: the total is shared by weight, sources whose share exceeds
max_epochs times their size are clamped there, and what they leave is shared again until none is above.
A source's target is met by whole repetitions of all its documents and one more of a seeded sample of whole
documents: those whose hash of doc_id is at most a cut, found by selecting on successive digits of the hash, so
that no task ever sorts a whole source.

Defined results: a null text has size 0; null is a source of its own, last in order; rows that repeat a doc_id
share a hash and are sampled together; an empty table gives an empty result; other columns pass through, but a
column that has the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.llm.common import packed, publish, table, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: More sources than that are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
#: The hash has 48 bits; the first two digits have ten bits each.
DIGITS = (38, 28)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, seed: str) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """sizes: source, source_size. Adds weight and target (double)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    sized = publish(sizes.select("source", "source_size", weight.cast("long").alias("weight")))
    cap = F.col("source_size") * max_epochs
    level, before = 0.0, None
    while level != before:
        before = level
        clamped = cap < F.lit(level) * F.col("weight")
        row = sized.agg(F.sum("source_size").alias("all"), F.sum(F.when(clamped, cap)).alias("held"), F.sum(F.when(~clamped, F.col("weight"))).alias("free")).first()
        level = (share * row["all"] - (row["held"] or 0)) / row["free"] if row["free"] else before
    share_of = F.lit(level) * F.col("weight")
    return sized.withColumn("target", F.when(cap < share_of, cap.cast("double")).otherwise(share_of))


def join_sources(df: DataFrame, sources: DataFrame, many: bool, *on: Column) -> DataFrame:
    """Null-safe join of a table with a column _source to one row a source."""
    side = sources if many else F.broadcast(sources)
    return df.join(side, F.col("_source").eqNullSafe(F.col("_of")), "inner")


def sample_cuts(hashed: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    """sources: _of, _rest (words still wanted). Adds _cut: documents with a hash up to it are taken once more.
    hashed: _source, _size, _u. Each step sums the sizes by the next digit within the digit that holds the cut."""
    held = sources.select("_of", "_rest", F.lit(0).cast("long").alias("_base"), F.lit(0).cast("long").alias("_prefix"))
    for at, shift in enumerate([*DIGITS, 0]):
        inside = join_sources(hashed, held, many)
        if at:
            inside = inside.filter(F.shiftright("_u", DIGITS[at - 1]) == F.col("_prefix"))
        sums = inside.groupBy("_of", F.shiftright("_u", shift).alias("_digit")).agg(F.sum("_size").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_base").alias("_base"))
        order = Window.partitionBy("_of").orderBy("_digit")
        sums = sums.withColumn("_upto", F.col("_base") + F.sum("_sum").over(order)).withColumn("_from", F.col("_upto") - F.col("_sum"))
        over = (F.col("_from") < F.col("_rest")) & (F.col("_upto") >= F.col("_rest"))
        if shift:
            held = publish(sums.filter(over).select("_of", "_rest", F.col("_from").alias("_base"), F.col("_digit").alias("_prefix")))
        else:
            nearer = F.col("_upto") - F.col("_rest") <= F.col("_rest") - F.col("_from")
            taken = (F.col("_from") < F.col("_rest")) & ((F.col("_upto") < F.col("_rest")) | nearer)
            first = F.shiftleft(F.max("_prefix"), DIGITS[-1]) - 1
            exact = sums.join(held.select(F.col("_of").alias("_key"), "_prefix"), F.col("_of").eqNullSafe(F.col("_key"))).groupBy("_of").agg(F.coalesce(F.max(F.when(taken, F.col("_digit"))), first).alias("_cut"))
    cuts = exact.select(F.col("_of").alias("_key"), "_cut")
    return sources.join(cuts, F.col("_of").eqNullSafe(F.col("_key")), "left").drop("_key", "_rest").fillna(-1, ["_cut"])


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", carry: bool = True) -> DataFrame:
    """docs: doc_id, text, source. Adds size, source_size, target, repeats and taken (repeats * size) to the columns of
    docs, or without carry to doc_id."""
    results = ("size", "source_size", "target", "repeats", "taken")
    columns = [c for c in docs.columns if c not in results] if carry else ["doc_id"]
    docs = packed(docs, "doc_id", "text", "source") if carry else docs.select("doc_id", "text", "source")
    keep = ["doc_id", *(c for c in docs.columns if c != "doc_id" and carry)]
    hashed = docs.select(*keep, F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), doc_hash(F.col("doc_id"), seed).alias("_u"))
    if carry:
        narrow = publish(hashed.select("_source", "_size", "_u"))
    else:  # the words are counted once
        hashed = publish(hashed)
        narrow = hashed.select("_source", "_size", "_u")
    targets = source_targets(narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, share, max_epochs)
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size == 0, 0).otherwise(F.floor(target / F.greatest(size, F.lit(1)))).cast("long")
    sources = publish(targets.select(F.col("source").alias("_of"), "source_size", "target", whole.alias("_whole"), (target - whole * size).alias("_rest")))
    many = sources.count() > BROADCAST_SOURCES
    sources = publish(sample_cuts(narrow, sources, many))
    repeats = F.col("_whole") + F.when(F.col("_u") <= F.col("_cut"), 1).otherwise(0)
    return join_sources(hashed, sources, many).select(*unpacked(columns, "doc_id", "text", "source"), F.col("_size").alias("size"), "source_size", "target", repeats.alias("repeats"), (repeats * F.col("_size")).alias("taken"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, carry=False).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM s),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS held, all_weight - coalesce(sum(weight) OVER before, 0) AS free
  FROM r WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min((1.5::DOUBLE * total - held::DOUBLE) / free::DOUBLE, k) AS level
  FROM c WHERE 2 * source_size >= (1.5::DOUBLE * total - held::DOUBLE) / free::DOUBLE * weight),
t AS (
  SELECT source, source_size, CASE WHEN 2 * source_size < level * weight THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM s, l),
w AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / greatest(source_size, 1))::BIGINT END AS whole FROM t),
u AS (
  SELECT source, u, sum(size)::BIGINT AS n FROM d GROUP BY source, u),
v AS (
  SELECT source, u, n, sum(n) OVER (PARTITION BY source ORDER BY u)::BIGINT AS upto FROM u),
x AS (
  SELECT w.source, max(v.u) AS cut
  FROM w JOIN v ON w.source IS NOT DISTINCT FROM v.source
  WHERE upto - n < target - whole * source_size
    AND (upto < target - whole * source_size
         OR upto - (target - whole * source_size) <= (target - whole * source_size) - (upto - n))
  GROUP BY w.source)
SELECT d.doc_id, d.size, w.source_size, w.target,
       (w.whole + CASE WHEN d.u <= coalesce(x.cut, -1) THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
