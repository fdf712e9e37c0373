"""Tables that keyed changes touch in few files.

A table is a folder. Its rows lie in buckets by a hash of the key, a folder each (`rows/<run>/bucket=<b>`); a manifest
(`manifest/version=<v>`, a row a bucket) says in which run's folder each bucket's present rows are. A change reads and
writes the buckets of the keys that it names and no others, and ends with a new manifest, which appears as a whole or not
at all: a run that fails leaves the table as it was, and what was read by an older manifest stays readable until
remove_old(). Of two changes that start from one version the second to end fails with FileExistsError, and is to be run
again.

Defined results: rows with a null key share a bucket; buckets without rows have no folder; an empty table has a manifest
with no buckets. A manifest has a row a bucket, which passes through the driver; rows never do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediaweave.sources.shared import remove, staged

BUCKETS = 256
MANIFEST = "bucket int, run string"
ABOUT = -1  # the manifest's row that holds key, number of buckets and schema


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    buckets: int
    schema: StructType
    runs: dict[int, str]  # bucket: run that wrote its rows

    def paths(self, path: str, only: set[int] | None = None) -> list[str]:
        return [f"{path}/rows/{run}/bucket={b}" for b, run in sorted(self.runs.items()) if only is None or b in only]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version."""
    rows = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{path}/manifest")
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    found = {r.bucket: r.run for r in rows.filter(F.col("version") == version).collect()}
    if ABOUT not in found:
        raise FileNotFoundError(f"{path} has no version {version}")
    about = json.loads(found.pop(ABOUT))
    return Manifest(version, about["key"], about["buckets"], StructType.fromJson(about["schema"]), found)


def read(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The table's rows; with keys, a table that has the key column, all rows of the buckets that hold these."""
    m = manifest(spark, path)
    return _rows(spark, path, m, None if keys is None else _touched(keys, m))


def _touched(keys: DataFrame, m: Manifest) -> set[int]:
    return {r.b for r in keys.select(bucket_of(m.key, m.buckets).alias("b")).distinct().collect()}


def _rows(spark: SparkSession, path: str, m: Manifest, only: set[int] | None) -> DataFrame:
    paths = m.paths(path, only)
    return spark.read.schema(m.schema).parquet(*paths) if paths else spark.createDataFrame([], m.schema)


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[int, str]:
    """Writes rows by bucket as a new run; which buckets have rows. A large bucket is several tasks and files."""
    run, spark = uuid.uuid4().hex, rows.sparkSession
    target = f"{path}/rows/{run}"
    dealt = rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    try:
        dealt.write.partitionBy("bucket").parquet(target)
        written = spark.read.schema("bucket int").parquet(target)
        return {r.bucket: run for r in written.select("bucket").distinct().collect()}
    except BaseException:
        remove(spark, target)
        raise


def _commit(spark: SparkSession, path: str, m: Manifest, written: set[str]) -> Manifest:
    about = json.dumps({"key": m.key, "buckets": m.buckets, "schema": json.loads(m.schema.json())})
    rows = spark.createDataFrame([(ABOUT, about), *m.runs.items()], MANIFEST).coalesce(1)
    try:
        staged(spark, f"{path}/manifest/version={m.version}", rows.write.mode("error").parquet)
    except BaseException:
        for run in written:
            remove(spark, f"{path}/rows/{run}")
        raise
    return m


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Manifest:
    """Writes a new table. Choose the buckets so that one holds some hundred MB; a table with a column `bucket` is refused."""
    if "bucket" in rows.columns:
        raise ValueError("a column may not be called bucket")
    runs = _write(rows, path, key, buckets)
    return _commit(rows.sparkSession, path, Manifest(0, key, buckets, StructType.fromJson(json.loads(rows.schema.json())), runs), set(runs.values()))


def change(spark: SparkSession, path: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> Manifest:
    """apply(rows, changes) gives the new rows of the buckets that the changes' keys name, from their present ones: an update,
    an upsert or a delete. It may not move a row to another key. No changes, no new version."""
    m = manifest(spark, path)
    only = _touched(changes, m)
    if not only:
        return m
    new = apply(_rows(spark, path, m, only), changes).select(*m.schema.names)
    runs = _write(new, path, m.key, m.buckets)
    written = set(runs.values())
    if strays := set(runs) - only:
        for run in written:
            remove(spark, f"{path}/rows/{run}")
        raise ValueError(f"the change makes rows of buckets that its keys don't name: {sorted(strays)[:5]}")
    kept = {b: run for b, run in m.runs.items() if b not in only}
    return _commit(spark, path, Manifest(m.version + 1, m.key, m.buckets, m.schema, kept | runs), written)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """For change(): the rows without those of the keys."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def remove_old(spark: SparkSession, path: str) -> int:
    """Deletes the manifests before the newest, and buckets that only they name. How many buckets went."""
    new = manifest(spark, path)
    current = set(new.paths(path))
    rows = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{path}/manifest").filter(F.col("version") < new.version)
    old = rows.filter(F.col("bucket") != ABOUT).select("bucket", "run").distinct().collect()
    versions = [r.version for r in rows.select("version").distinct().collect()]
    gone = {f"{path}/rows/{r.run}/bucket={r.bucket}" for r in old} - current
    for version in versions:
        remove(spark, f"{path}/manifest/version={version}")
    for folder in gone:
        remove(spark, folder)
    return len(gone)
