"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_published: list[str] = []
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may leave it unset; it then gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mediaweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mediaweave-{uuid.uuid4().hex}"


def publish(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut, an executor's loss costs nothing,
    and the planner knows its real size. The shuffle files of the writing query go when it is done."""
    return publish_by(df)[0]


def publish_by(df: DataFrame, *parts: str) -> tuple[DataFrame, str]:
    """The same with a folder for each value of the parts; also the table's path, so that remove() can take a part."""
    spark = df.sparkSession
    path = scratch_path(spark)
    was = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.partitionBy(*parts).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if was is None else spark.conf.set(CLEAN_UP, was)
    _published.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never copied: the planner takes a written table's compressed size for its size and
    does not count the rows that explode() adds, so that what it would copy may be a hundred times its threshold."""
    return df.hint("merge")


@contextmanager
def published_since() -> Iterator[list[str]]:
    """A list that holds, after the block, the paths of the tables published within it."""
    own, before = [], len(_published)
    yield own
    own += _published[before:]


def staged(spark: SparkSession, target: str, write) -> None:
    """Lets write(path) fill a hidden folder beside the target, which takes its name only when that ends well; after an error
    nothing of the run is left. target must not exist."""
    parent, _, name = target.rstrip("/").rpartition("/")
    target_path, stage_path = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (target, f"{parent}/.{name}-{uuid.uuid4().hex}"))
    files = target_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(stage_path.toString())
        if files.exists(target_path) or not files.rename(stage_path, target_path):
            raise FileExistsError(target)
    except BaseException:
        files.delete(stage_path, True)
        raise


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_published(spark: SparkSession) -> int:
    """Deletes all that publish() has written in this session; call it when the results that read it are written."""
    n = len(_published)
    while _published:
        remove(spark, _published.pop())
    return n


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once a session, unless they find it as the driver does (PYTHONPATH or folder)."""
    package = Path(__file__).resolve().parents[1]
    root = str(package.parent)
    if root in map(os.path.abspath, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]) or getattr(spark.sparkContext, "_mediaweave_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="mediaweave-")) / "mediaweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in package.rglob("*.py"):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._mediaweave_shipped = True
