"""A topic kept in files, with partitions and offsets, where there is no message broker: `topic_log` as a source and sink.

Each append adds one file a partition, named by the offsets it holds, so the names tell where each partition ends. A stream
reads ranges of offsets, a task for each partition; what a query has read is in its own checkpoint, and `maxOffsetsPerTrigger`
bounds a batch. Columns are those of a broker's stream (partition, offset, value), so the jobs behind are the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .objects import store_of

SCHEMA = "partition int, offset long, value string"


def files(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """For each partition its files: (first offset, behind the last, path), in order."""
    from pyarrow import fs

    store, root = store_of(path)
    out: dict[int, list[tuple[int, int, str]]] = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = f.path.rpartition("/")
        if f.is_file and name.endswith(".jsonl") and "/partition=" in folder:
            start, end = map(int, name.removesuffix(".jsonl").split("-"))
            out.setdefault(int(folder.rsplit("=", 1)[1]), []).append((start, end, f.path))
    return {p: sorted(x) for p, x in out.items()}


def ends(path: str) -> dict[str, int]:
    return {str(p): x[-1][1] for p, x in files(path).items()}


@dataclass
class Range(InputPartition):
    partition: int
    start: int
    end: int


class Reader(DataSourceStreamReader):
    """Offsets are {partition: the next offset to read}."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("maxOffsetsPerTrigger", options.get("maxoffsetspertrigger", 0)))
        self.group = options.get("group")
        if self.most and not self.group:
            raise ValueError("maxOffsetsPerTrigger needs a group, so that a restart goes on from the right offsets")
        self.upto: dict[str, int] = self._noted()

    def _noted(self) -> dict[str, int]:
        """Where the group's last planned batch ended, so that a restart keeps to the limit; what is read is the checkpoint's say."""
        from pyarrow import fs

        store, root = store_of(self.path)
        if not self.group or store.get_file_info(f"{root}/_groups/{self.group}").type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(f"{root}/_groups/{self.group}") as f:
            return json.loads(f.read().decode())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last = ends(self.path)
        if self.most:
            share = max(1, self.most // max(1, len(last)))
            last = {p: min(n, self.upto.get(p, 0) + share) for p, n in last.items()}
        self.upto = last
        return last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.group:
            store, root = store_of(self.path)
            store.create_dir(f"{root}/_groups", recursive=True)
            with store.open_output_stream(f"{root}/_groups/{self.group}") as f:
                f.write(json.dumps(end).encode())
        return [Range(int(p), start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for first, behind, path in files(self.path).get(part.partition, []):
            if behind <= part.start or first >= part.end:
                continue
            with store.open_input_stream(path) as f:
                for k, line in enumerate(f.read().decode().split("\n")[: behind - first], first):
                    if part.start <= k < part.end:
                        yield part.partition, k, json.loads(line)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Part(WriterCommitMessage):
    files: list[tuple[int, int, str]]  # partition, records, path


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.pending = path.rstrip("/"), f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Part:
        store, root = store_of(self.path)
        store.create_dir(f"{root}/{self.pending}", recursive=True)
        open_: dict[int, list] = {}
        for row in rows:
            p = row["partition"]
            if p not in open_:
                name = f"{root}/{self.pending}/{uuid.uuid4().hex}"
                open_[p] = [store.open_output_stream(name), 0, name]
            open_[p][0].write((json.dumps(row["value"]) + "\n").encode())
            open_[p][1] += 1
        for f, _, _ in open_.values():
            f.close()
        return Part([(p, n, name) for p, (_, n, name) in open_.items()])

    def commit(self, messages: list[Part | None]) -> None:
        store, root = store_of(self.path)
        last = ends(self.path)
        for p, n, name in (f for m in messages if m for f in m.files):
            start = last.get(str(p), 0)
            store.create_dir(f"{root}/partition={p}", recursive=True)
            store.move(name, f"{root}/partition={p}/{start:015d}-{start + n:015d}.jsonl")
            last[str(p)] = start + n
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        if store.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.pending}")


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def publish(values: DataFrame, path: str, partitions: int = 4, key: str | None = None) -> None:
    """Add rows (value, and the column `key` if named) to a topic: rows of one key go to one partition. One writer at a time."""
    spark = values.sparkSession
    spark.dataSource.register(TopicLog)
    part = F.pmod(F.xxhash64(key or "value"), F.lit(partitions)).cast("int")
    rows = values.select(part.alias("partition"), F.lit(None).cast("long").alias("offset"), F.col("value").cast("string").alias("value"))
    rows.repartition(partitions, "partition").write.format("topic_log").mode("append").save(path)


def subscribe(spark: SparkSession, path: str, most: int = 0, group: str = "") -> DataFrame:
    """A stream of (partition, offset, value). most: records a batch at most (0: all), which needs a group: a name under
    which the offsets of the last batch are noted, so that a restart goes on from them."""
    spark.dataSource.register(TopicLog)
    reader = spark.readStream.format("topic_log").option("maxOffsetsPerTrigger", most)
    return (reader.option("group", group) if group else reader).load(path)
