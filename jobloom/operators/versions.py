"""Current and superseded versions of job records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def current(records: DataFrame, key: str = "url_hash", *order: str) -> DataFrame:
    """The latest version of each key; order: columns that sort the versions, the last of them unique. No window: the
    versions are reduced before the shuffle."""
    order = order or ("seen_at",)
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in records.columns])


def split(records: DataFrame, key: str = "url_hash", *order: str) -> tuple[DataFrame, DataFrame]:
    """(current, history): the latest version of each key, and the older ones."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order or ("seen_at",)])
    ranked = records.withColumn("__n", F.row_number().over(w))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")
