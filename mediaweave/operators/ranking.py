"""Ranks over a whole table or large groups of it, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaweave.sources.shared import publish

WITHIN = 33  # bits that number the rows of a partition in monotonically_increasing_id()


def _by_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """The rows dealt by ranges of the order, sorted there and written: adds _at, their number, and _part, their partition."""
    sorted_ = publish(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return sorted_.withColumn("_part", F.shiftright("_at", WITHIN))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds each row's place in the order, from 0. The counts of the partitions, one row each, give every partition its
    offset. The order should tell all rows apart."""
    sorted_ = _by_ranges(df, *order)
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = sorted_.join(F.broadcast(offsets), "_part")  # one row a partition
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))).drop("_part", "_before", "_at")


def rank_in_group(df: DataFrame, group: str, *order: Column, name: str = "place") -> DataFrame:
    """Adds each row's place in its group, from 1; a group may hold any share of the rows. Groups are sorted one after the
    other by ranges, so that a group is a run of rows in each of some partitions: a row's place is its place in the run
    and the lengths of the group's runs before. Rows meet their run's row, by partition and group. Rows without a group
    have no place and no row."""
    sorted_ = _by_ranges(df.filter(F.col(group).isNotNull()), F.col(group).asc(), *order)
    runs = sorted_.groupBy("_part", group).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")  # a row a partition at most
    runs = runs.select("_part", group, F.col("_start") - before - 1)
    runs = runs.toDF("_part", group, "_zero")
    return sorted_.join(runs, ["_part", group]).withColumn(name, (F.col("_at") - F.col("_zero")).cast("int")).drop("_part", "_at", "_zero")
