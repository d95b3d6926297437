"""Tables kept in buckets by the hash of a key, so that joins on the key move the other side only.

A table is a folder of Parquet files whose bucket Spark knows from the catalog; every session registers the folder under a
name that follows from its path. Rows are dealt to the buckets before they are written, so an append adds one file a bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def registered(spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS, partition: str = "") -> str:
    """The name of the table in folder `path`; schema: its columns as DDL. The number of buckets is fixed by the first writer
    and must be given alike ever after. partition: a column of schema that makes folders above the buckets."""
    name = f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    by = f"PARTITIONED BY ({partition}) " if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {by}CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def read(spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS, partition: str = "") -> DataFrame:
    """The table's rows, as the files stand now."""
    name = registered(spark, path, schema, key, buckets, partition)
    if partition:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append(df: DataFrame, path: str, schema: str, key: str, buckets: int = BUCKETS, partition: str = "") -> None:
    """Add rows: dealt by key into as many partitions as buckets, each of which writes one file."""
    spark = df.sparkSession
    name = registered(spark, path, schema, key, buckets, partition)
    df.select(*spark.table(name).columns).repartition(buckets, key).write.insertInto(name)
