"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder is set: of the warehouse, which a cluster shares, or a temporary one if the master is local."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        own = f"file://{tempfile.mkdtemp(prefix='quire-')}" if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_quire"
        held = known.get() if known.isDefined() else own
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """The rows of df from a table written once, so that lineage ends there and what depends on their partitions agrees."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own in the shared folder, deleted when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    _tables.append((spark, uri))
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def drop(df: DataFrame) -> None:
    """Deletes the table that ``staged`` returned; nothing lazy may still need it."""
    bare = lambda p: p.split("://")[-1]
    folders = {bare(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    for item in [x for x in _tables if any(f.endswith(bare(x[1])) or bare(x[1]).endswith(f) for f in folders)]:
        _tables.remove(item)
        _delete(*item)


@atexit.register
def clear() -> None:
    """Deletes the tables of this driver; DataFrames that read them end with it."""
    while _tables:
        _delete(*_tables.pop())
