"""Pages and positions from a stored order, each of which reads a small part of it.

write_order() sorts a table once. Its rows lie in folders, one for each range of the order (`rows/order_range=<r>`), with
their place within the range; `ranges` has a row a range with its exact count and the count of all before; `ids` says by
hash of the id in which range and at which place a row is. A page at any offset reads the one or two ranges that hold
it, and a position the ids' buckets of its targets: neither sorts, counts or lists the rest.

Nulls come first upwards and last downwards, ties go by id, as in browse.photo_page(). A filter belongs to the order: it
is written from filtered rows. The order is that of the time it was written. Rows may not have columns called
order_range, order_place or order_bucket. Ids should tell all rows apart.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from mediaweave.operators.browse import sort_key
from mediaweave.operators.ranking import WITHIN
from mediaweave.sources.buckets import bucket_of
from mediaweave.sources.shared import staged

IDS, RANGES = "id long, order_range int, order_place long, order_bucket int", "order_range int, n long, before long"


@dataclass(frozen=True)
class Order:
    path: str
    schema: StructType
    buckets: int
    ranges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.ranges.sparkSession


def write_order(rows: DataFrame, path: str, sort_by: str = "exif_date", sort_dir: str = "ASC", ranges: int | None = None) -> Order:
    """Writes the order of a table (with ids) to a new folder. A range should hold some hundred MB; by default there are as
    many as shuffle partitions."""
    spark = rows.sparkSession
    column, down = sort_key(sort_by, sort_dir)
    order = (F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_first(), F.col("id").asc())
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("_at")
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"order_range": F.shiftright(at, WITHIN).cast("int"), "order_place": at.bitwiseAND(F.lit((1 << WITHIN) - 1))}).drop("_at")
    about = json.dumps({"schema": json.loads(rows.schema.json()), "buckets": ranges})

    def write(stage: str) -> None:
        placed.write.partitionBy("order_range").parquet(f"{stage}/rows")
        written = spark.read.schema("id long, order_place long, order_range int").parquet(f"{stage}/rows")
        counts = written.groupBy("order_range").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("order_range")) - F.col("n")  # one row a range
        counts.select("order_range", "n", before.alias("before")).coalesce(1).write.parquet(f"{stage}/ranges")
        ids = written.withColumn("order_bucket", bucket_of("id", ranges)).hint("rebalance", "order_bucket")
        ids.write.partitionBy("order_bucket").parquet(f"{stage}/ids")
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{stage}/about")

    staged(spark, path, write)
    return read_order(spark, path)


def read_order(spark: SparkSession, path: str) -> Order:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Order(path, StructType.fromJson(about["schema"]), about["buckets"], spark.read.schema(RANGES).parquet(f"{path}/ranges"))


def page(order: Order, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of 1 to 1000 rows, in order. Reads the ranges that it lies in; their rows, one each, pass through the driver."""
    end = offset + max(1, min(limit, 1000))
    hold = order.ranges.filter((F.col("before") < end) & (F.col("before") + F.col("n") > offset)).collect()
    if not hold:
        return order.spark.createDataFrame([], order.schema)
    schema = StructType([*order.schema.fields]).add("order_place", LongType()).add("order_range", IntegerType())
    root = f"{order.path}/rows"
    rows = order.spark.read.option("basePath", root).schema(schema).parquet(*(f"{root}/order_range={r.order_range}" for r in hold))
    parts = [(F.col("order_range") == r.order_range) & F.col("order_place").between(offset - r.before, end - 1 - r.before) for r in hold]
    wanted = parts[0]
    for part in parts[1:]:
        wanted |= part
    return rows.filter(wanted).orderBy("order_range", "order_place").select(*order.schema.names)


def positions(order: Order, targets: DataFrame, page_size: int = 100) -> DataFrame:
    """targets: id. Where rows stand: id, row_index, page, found; (0, 0, false) if they don't. Reads the buckets of ids that the
    targets name: their numbers, no more than there are ranges, pass through the driver."""
    named = [r.b for r in targets.select(bucket_of("id", order.buckets).alias("b")).distinct().collect()]
    there = order.spark.read.schema(IDS).parquet(f"{order.path}/ids").filter(F.col("order_bucket").isin(named))
    index = F.col("before") + F.col("order_place")
    found = there.join(F.broadcast(order.ranges), "order_range").select("id", index.alias("i"))  # one row a range
    out = targets.select("id").join(found, "id", "left")
    return out.select("id", F.coalesce("i", F.lit(0)).alias("row_index"), F.coalesce(F.expr(f"i DIV {page_size}"), F.lit(0)).alias("page"), F.col("i").isNotNull().alias("found"))
