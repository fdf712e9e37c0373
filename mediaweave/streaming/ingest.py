"""Incremental ingest with Structured Streaming. No watermark: a late photo must still match stored ones.

What a batch writes goes to a folder of its own, overwritten if the batch runs again, and a stream that is started again
goes on from its checkpoint; both are under the stream's path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.operators.clusters import incremental_clusters
from mediaweave.operators.components import extend_components
from mediaweave.sources.ingest import KEY

STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_files(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream that takes so many files a batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files)).parquet(folder)


def run_batches(arriving: DataFrame, handle: Callable[[DataFrame, int], None], path: str) -> None:
    """Hands what has arrived since the last run to handle(rows, batch), batch by batch, and returns when it is done. State
    is kept on disk, however many keys there are; the session's own setting comes back."""
    conf = arriving.sparkSession.conf
    was = conf.get(STORE, None)
    conf.set(STORE, ON_DISK)
    try:
        arriving.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(STORE) if was is None else conf.set(STORE, was)


def stored_rows(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What earlier batches wrote; a batch that runs again does not see its own first run."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    return (rows if before is None else rows.filter(f"batch < {before}")).drop("batch")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def stream_ingest(arriving: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, key: list[str] = KEY) -> DataFrame:
    """Rows whose key has not come before, in this batch or an earlier one: the first of each key as it arrives. The keys
    are the stream's state: a batch reads its own rows and looks their keys up, and never what is stored."""
    fresh = prepare(arriving).dropDuplicates(key)
    run_batches(fresh, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}"), path)
    return stored_rows(arriving.sparkSession, f"{path}/rows", ddl(fresh))


def stream_clusters(arriving: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Assigns each batch's photos to clusters, against all photos of the batches before: photos with cluster_id."""
    spark, rows_path = arriving.sparkSession, f"{path}/rows"

    def handle(rows: DataFrame, batch: int) -> None:
        rows = prepare(rows).drop("cluster_id")
        old = stored_rows(spark, rows_path, f"{ddl(rows)}, cluster_id long", batch) if batch else rows.limit(0).selectExpr("*", "id AS cluster_id")
        found = incremental_clusters(rows, old).select("id", "cluster_id")
        rows.join(found, "id").select(*rows.columns, "cluster_id").write.mode("overwrite").parquet(f"{rows_path}/batch={batch}")

    run_batches(arriving, handle, path)
    return stored_rows(spark, rows_path, f"{ddl(prepare(arriving).drop('cluster_id'))}, cluster_id long")


LABELS, MERGES = "node long, component long", "was long, now long"


def stream_components(arriving: DataFrame, path: str, src: str = "a", dst: str = "b") -> tuple[DataFrame, DataFrame]:
    """Links as they arrive: the components of all that came (node, component), and which were merged when (batch, was,
    now). A batch writes the labels that it changes and its merges; the components don't depend on the order of links."""
    spark = arriving.sparkSession

    def handle(rows: DataFrame, batch: int) -> None:
        labels = stored_rows(spark, f"{path}/labels", LABELS, batch) if batch else spark.createDataFrame([], LABELS)
        changed, merges = extend_components(labels, rows, src, dst)
        changed.write.mode("overwrite").parquet(f"{path}/labels/batch={batch}")
        merges.write.mode("overwrite").parquet(f"{path}/merges/batch={batch}")

    run_batches(arriving, handle, path)
    labels = stored_rows(spark, f"{path}/labels", LABELS).groupBy("node").agg(F.min("component").alias("component"))
    merges = spark.read.schema(f"{MERGES}, batch long").option("basePath", f"{path}/merges").parquet(f"{path}/merges")
    return labels, merges.select("batch", "was", "now")
