"""2. Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text. A round counts each group's next digit (a run
of bytes, wider each round, so that long texts take few rounds) with map-side combining, so a group of copies
costs one row a task. Groups of one document are done, and so are groups whose text has ended: what is left in
them is equal byte for byte, without any digest. Only the rest goes on, with the rest of its text. Documents learn
their group by a join that deals the rows of a large group to many tasks.

Defined results: a null text is empty; a null doc_id counts as the smallest; of rows that repeat text and doc_id
one is kept; an empty table gives an empty result. A text of any length takes rounds by its logarithm; it has to
fit a row. Columns other than doc_id and text are carried or not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import REST, join_by_size, lower_ascii, packed, publish, publish_by, remove, table, unpacked

#: Bytes of the first digit, and how many times wider each next one is.
FIRST, WIDER = 32, 8
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs: doc_id, text. One row a document: doc_id, keep_id, group_size, kept, text_sha256. With carry also the
    document's other columns, its text where it is kept; a column that has the name of a result is replaced."""
    columns = [c for c in docs.columns if c not in RESULTS]
    docs = packed(docs, "doc_id", "text") if carry else docs.select("doc_id", "text")
    others = [c for c in docs.columns if c == REST]
    text = lower_ascii(F.col("text")).cast("binary")
    head = lower_ascii(F.substring("text", 1, FIRST)).cast("binary")  # so that counting the first digit lowers no more
    found = docs.select("doc_id", *others, "text", F.sha2(text, 256).alias("text_sha256"), F.substring(head, 1, FIRST).alias("_digit"), F.lit(0).cast("long").alias("_group"))
    done, spent, at, width = [], None, 0, FIRST
    while True:
        groups = found.groupBy("_group", "_digit").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_keep")).filter("_n > 1")
        groups = publish(groups.withColumn("_next", F.monotonically_increasing_id()))
        single = F.col("_n").isNull()
        ended = single | (F.octet_length("_digit") < width)
        kept = single | F.col("doc_id").eqNullSafe(F.col("_keep"))
        joined = join_by_size(found, groups, ["_group", "_digit"], "_n").select(
            "doc_id", *others, "text_sha256", F.col("_next").alias("_group"), ended.alias("_ended"), F.monotonically_increasing_id().alias("_row"),
            F.when(ended, F.coalesce("_keep", "doc_id")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"),
            F.when(~ended | (kept & F.lit(carry)), F.col("text")).alias("text"),
        )
        joined, path = publish_by(joined, "_ended")
        if spent:  # the texts that the round before left open have been read
            remove(docs.sparkSession, spent)
        spent = f"{path}/_ended=false"
        done.append(one_kept(joined.filter("_ended")).select("doc_id", *others, *(["text"] * carry), *RESULTS))
        state = joined.filter("NOT _ended").select("doc_id", *others, "text", "text_sha256", "_group")
        if state.isEmpty():
            whole = reduce(DataFrame.unionAll, done)
            return whole.select(*unpacked(columns, "doc_id", "text"), *RESULTS) if carry else whole
        at, width = at + width, width * WIDER
        found = state.withColumn("_digit", F.substring(text, at + 1, width))


def one_kept(ended: DataFrame) -> DataFrame:
    """Where rows repeat a group's largest doc_id, all but one of them are not kept."""
    ties = publish(ended.filter("kept AND group_size > 1").groupBy("_group").agg(F.max("_row").alias("_top"), F.count("*").alias("_tops")).filter("_tops > 1"))
    if ties.isEmpty():
        return ended
    tied = ended.filter("kept AND group_size > 1").select("_group", "_row")
    lost = publish(join_by_size(tied, ties, ["_group"], "_tops", "inner").filter("_row != _top").select("_row"))
    return ended.join(lost.withColumn("_lost", F.lit(True)), "_row", "left").withColumn("kept", F.col("kept") & F.col("_lost").isNull())


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
