"""Names of new folders on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir.

    Where that is unset, a local master (one machine, as in tests) gets a temporary folder; a cluster must name one, since
    its machines don't share their disks. Whoever owns the folder removes what jobs have left in it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# A few names and small files in any store that Spark reaches, from the driver.


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    store, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A new small file that appears with all its lines or not at all; an error if there is one already."""
    store, where = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write("\n".join(lines).encode())
    out.close()
    if not store.rename(draft, where):
        store.delete(draft, True)
        raise FileExistsError(path)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    store, where = _at(spark, path)
    size = store.getFileStatus(where).getLen()
    stream = store.open(where)
    try:
        text = bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()
    return text.split("\n") if text else []
