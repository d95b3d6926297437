"""Texts as objects under given keys of a bucket: a writer that leaves all named keys or none of them.

Tasks write what they hold below a pending folder of their own write; only when every task is done are the objects moved to
their keys, and a failed write removes the pending folder. For outputs of some thousands of objects (reports, exports, pages):
their names pass through the driver, their contents don't. Paths are those that pyarrow's file systems reach (local, s3, hdfs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MOVERS = 16


def store_of(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    keys: list[str]


class ObjectWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.pending = path.rstrip("/"), overwrite, f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        store, root = store_of(self.path)
        keys, attempt = [], TaskContext.get().taskAttemptId()
        for row in rows:
            if not row["key"] or ".." in row["key"].split("/"):
                raise ValueError(f"not a key: {row['key']!r}")
            name = f"{attempt}/{row['key']}"
            store.create_dir(f"{root}/{self.pending}/{name}".rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{root}/{self.pending}/{name}") as out:
                out.write((row["text"] or "").encode())
            keys.append(name)
        return Written(keys)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        store, root = store_of(self.path)
        names = [n for m in messages if m for n in m.keys]
        keys = [n.split("/", 1)[1] for n in names]
        if len(set(keys)) < len(keys):
            self.abort(messages)
            raise ValueError("a key was written twice")
        if not self.overwrite and keys and any(i.type != FileType.NotFound for i in store.get_file_info([f"{root}/{k}" for k in keys])):
            self.abort(messages)
            raise FileExistsError("a key is there already")

        def move(pair: tuple[str, str]) -> None:
            store.create_dir(f"{root}/{pair[1]}".rsplit("/", 1)[0], recursive=True)
            store.move(f"{root}/{self.pending}/{pair[0]}", f"{root}/{pair[1]}")

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(move, zip(names, keys)))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        store, root = store_of(self.path)
        if store.get_file_info(f"{root}/{self.pending}").type == FileType.Directory:
            store.delete_dir(f"{root}/{self.pending}")


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "key string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"], overwrite)


def put_objects(texts: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write each row (key, text) as the object path/key, UTF-8; a null text is an empty object. Keys must differ. Not
    overwrite: an error, and nothing written, if one of the keys is there."""
    texts.sparkSession.dataSource.register(Objects)
    texts.select("key", "text").write.format("objects").mode("overwrite" if overwrite else "append").save(path)


def get_objects(spark: SparkSession, path: str) -> DataFrame:
    """key and text of all objects below a path; empty ones, which Spark's readers pass over, are listed on the driver."""
    from pyarrow import fs

    store, root = store_of(path.rstrip("/"))
    empty = [(f.path.removeprefix(root).lstrip("/"), "") for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.size]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return spark.createDataFrame(empty, "key string, text string").unionByName(found.select(_below("path", path).alias("key"), F.col("content").cast("string").alias("text")))


def _below(column: str, path: str) -> Column:
    return F.substring_index(column, path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
