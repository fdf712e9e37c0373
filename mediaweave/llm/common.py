"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediaweave.sources.shared import publish, publish_by, remove, shared_dir

__all__ = ["copied_if_small", "join_by_size", "lower_ascii", "map_rows", "packed", "publish", "publish_by", "remove", "shared_dir", "small_batches", "table", "unpacked"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: bound what one Arrow batch holds, unless the session asks for less already."""
    if int(spark.conf.get(ARROW_ROWS)) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null is empty. lower() is the fast way where there is nothing but ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Rows of one key that join_by_size() leaves in one task, and how many keys at most may have more.
MOST_ROWS, MOST_KEYS = 1000, 20_000


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, how: str = "left", most: int = MOST_ROWS, hint: str | None = "merge") -> DataFrame:
    """Joins a table to another (written) one that has one row a key, in which `size` tells how many rows of the left table
    have the key. Such a key's rows are dealt to as many tasks as hold `most` rows each, with a copy of the right
    row in each; `most` rises with the table, so that no more than MOST_KEYS keys are dealt and so broadcast."""
    row = right.agg(F.sum(size), F.max(size)).first()
    most = max(most, -(-(row[0] or 0) // MOST_KEYS))
    hinted = lambda df: df.hint(hint) if hint else df  # noqa: E731 without one the planner broadcasts what is under its threshold
    if (row[1] or 0) <= most:
        return left.join(hinted(right), keys, how)
    large = right.filter(F.col(size) > most).groupBy(F.xxhash64(*keys).alias("_key")).agg(F.ceil(F.max(size) / most).cast("int").alias("_parts")).collect()
    large = left.sparkSession.createDataFrame([tuple(x) for x in large], "_key long, _parts int")

    def dealt(df: DataFrame, part) -> DataFrame:
        found = df.withColumn("_key", F.xxhash64(*keys)).join(F.broadcast(large), "_key", "left")
        return found.withColumn("_part", part(F.coalesce("_parts", F.lit(1)))).drop("_key", "_parts")

    left = dealt(left, lambda parts: F.pmod(F.monotonically_increasing_id(), parts.cast("long")).cast("int"))
    right = dealt(right, lambda parts: F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(hinted(right), [*keys, "_part"], how).drop("_part")


#: Bytes that a table may have to be copied to every task.
SMALL_TABLE = 32 << 20


def copied_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A (written) table with the hint to broadcast it, if its rows of so many bytes are few enough; else as it is, for the
    planner to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_TABLE else df


REST = "_rest"


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct, so that none of their names can clash with an operator's. What is
    packed can be packed again."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, *([F.struct(*others).alias(REST)] if others else []))


def unpacked(columns: list[str], *names: str) -> list[Column]:
    """The columns of a table that packed() took, in their order."""
    return [F.col(c) if c in names else F.col(f"{REST}.`{c}`").alias(c) for c in columns]


def map_rows(docs: DataFrame, name: str, function, results: str) -> DataFrame:
    """Columns that a function makes from column `name`, beside those of docs; a column that has the name of a result is
    replaced. function(batches, names, out): the columns to pass on, and all in the order in which they are returned."""
    small_batches(docs.sparkSession)
    own = StructType.fromDDL(results)
    columns = [c for c in docs.columns if c not in own.names]
    docs = packed(docs, name)
    passing = [f for f in docs.schema.fields if f.name not in own.names]
    schema = StructType(passing + own.fields)
    found = docs.mapInArrow(partial(function, names=[f.name for f in passing], out=schema.names), schema)
    return found.select(*unpacked(columns, name), *own.names)
