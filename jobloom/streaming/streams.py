"""Streaming jobs: records from topics and files, to Parquet, distinct records.

Every source is a streaming DataFrame, so Kafka, files or a rate source serve alike. Progress lives in the checkpoint
folder, which must be on storage that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.queue import unknown
from ..sources import buckets
from ..sources.tables import RECORD_SCHEMA


def kafka(spark: SparkSession, servers: str, topics: str, options: dict[str, str] | None = None) -> DataFrame:
    """A stream of the values of Kafka topics (needs Spark's Kafka package)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**(options or {})).load()


def records(stream: DataFrame, schema: str = RECORD_SCHEMA, value: str = "value") -> DataFrame:
    """JSON values to columns; a value that isn't JSON is dropped."""
    return stream.select(F.from_json(F.col(value).cast("string"), schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def files(spark: SparkSession, path: str, schema: str, each: int | None = None) -> DataFrame:
    """Parquet files as a stream, `each` files a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", each) if each else reader).parquet(path)


def run_available(writer) -> None:
    """Process all that is there, batch by batch, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def to_parquet(stream: DataFrame, path: str, checkpoint: str, date: str):
    """A writer of records in Parquet folders by date; exactly once, by the sink's own log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(date).outputMode("append")


def distinct(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark; state older than that is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def distinct_in_windows(stream: DataFrame, keys: list[str], time: str, window: str, late: str) -> DataFrame:
    """A record of each key in each window of event time. A window's keys are let go once the watermark (`late` behind the
    newest record) has passed its end; records later than that are dropped (topics.first_of_window keeps them apart)."""
    windowed = stream.withWatermark(time, late).withColumn("__window", F.window(time, window))
    plain = windowed.withColumn(time, F.timestamp_micros(F.unix_micros(time)))  # only the window may carry the watermark
    return plain.dropDuplicates([*keys, "__window"]).drop("__window")


def unseen_to(path: str, schema: str, key: str, n: int = buckets.BUCKETS):
    """A batch function that adds rows whose key the table in buckets at `path` doesn't hold, one for each key. Only the batch
    is moved; a batch that comes again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        held = buckets.read(batch.sparkSession, path, schema, key, n)
        buckets.append(unknown(batch.repartition(n, key).dropDuplicates([key]), held, key=key), path, schema, key, n)

    return write
