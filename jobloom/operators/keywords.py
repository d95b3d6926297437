"""The keyword table: frontier, page requests, crawl results, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as t
from ..functions.urls import search_url
from ..sources.folders import shared_dir


def frontier(keywords: DataFrame, n: int = 10) -> DataFrame:
    """The next n keywords to crawl: never crawled first, then the oldest; ties by id. No keyword comes twice."""
    return keywords.orderBy(F.col("last_crawl").asc_nulls_first(), "id").limit(n).select("id", "keyword", "category")


def page_requests(keywords: DataFrame, start: int = 1, end: int = 2) -> DataFrame:
    """A row for each keyword and result page, with its slug and address; no shuffle."""
    return keywords.withColumn("slug", t.slug("keyword")).withColumn("page_no", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("url", search_url("slug", "page_no"))


def results(success: DataFrame, error: DataFrame) -> DataFrame:
    """Crawl results (id, crawl_time) of both kinds as one row for each id; an error beats a success, then the latest."""
    tagged = success.select("id", "crawl_time", F.lit("success").alias("status")).unionByName(error.select("id", "crawl_time", F.lit("error").alias("status")))
    rank = F.struct(F.when(F.col("status") == "error", 1).otherwise(0), "crawl_time")
    return tagged.groupBy("id").agg(F.max_by(F.struct("crawl_time", "status"), rank).alias("r")).select("id", F.col("r.crawl_time").alias("crawl_time"), F.col("r.status").alias("new_status"))


def apply_results(keywords: DataFrame, success: DataFrame, error: DataFrame) -> DataFrame:
    """keywords with last_crawl and status of those that were crawled brought up to date; unknown ids are ignored."""
    joined = keywords.join(results(success, error), "id", "left")
    new = {"last_crawl": F.coalesce("crawl_time", "last_crawl"), "status": F.coalesce("new_status", "status")}
    return joined.select(*[new[c].alias(c) if c in new else c for c in keywords.columns])


def start_at(items: DataFrame, base: str, minutes: int) -> DataFrame:
    """items with `start_at`: base plus `minutes` for each `number` before it; days and minutes apart, so that large numbers fit."""
    total = f"({minutes}L * number)"
    return items.withColumn("start_at", F.expr(f"TIMESTAMP_NTZ '{base}' + make_dt_interval(cast({total} div 1440 as int), 0, cast({total} % 1440 as int), 0)"))


def staggered(items: DataFrame, base: str, order: str = "id", minutes: int = 15) -> DataFrame:
    """Start times `start_at`: base plus `minutes` for each item before it, in order; `schedule_id` from its number.

    The list is numbered by range partitions and their counts, so no single task holds it. The partitions are written
    once, so that both sides of the join see the same ones.
    """
    spark = items.sparkSession
    ranged = items.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    path = shared_dir(spark, "numbered")
    ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(order))).write.parquet(path)
    own = spark.read.parquet(path)
    sizes = own.groupBy("__part").agg(F.max("__n").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    numbered = own.join(F.broadcast(before), "__part").withColumn("number", (F.col("__before") + F.col("__n") - 1).cast("long"))  # a row for each partition
    return start_at(numbered, base, minutes).withColumn("schedule_id", t.schedule_id("number", "keyword")).drop("__part", "__n", "__before")
