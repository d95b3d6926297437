"""Sources and sinks. Paths may be in any store that Spark reaches (a bucket is a path like s3a://bucket/prefix); texts under
keys of their own are in `objects`, topics without a broker in `topic_log`, tables in buckets in `buckets`."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as t
from ..operators.extract import LINK_COLUMNS
from ..operators.queue import QUEUE_COLUMNS, enqueue
from ..operators.wide import WIDE_COLUMNS, relational
from . import buckets

LINK_SCHEMA = ", ".join(f"{c} string" for c in [*LINK_COLUMNS, "url_hash"])
PAGE_SCHEMA = "page_id long, url string, html string"
QUEUE_SCHEMA = "url string, hash_value string, status string, attempts int, last_error string, next_try_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, source string"
RECORD_SCHEMA = ", ".join(f"{c} string" for c in WIDE_COLUMNS)


def read_keyword_lists(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """(keyword, category) of a folder of .txt lists: one keyword a line, the file's name is the category."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    out = lines.select(t.clean_ends("value").alias("keyword"), F.replace(F.url_decode("file"), F.lit(".txt"), F.lit("")).alias("category")).where("keyword <> ''")
    return out.distinct() if distinct else out


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows as Parquet."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def write_links(links: DataFrame, path: str, slug: str = "keyword_slug", time: str = "crawl_ts") -> None:
    """Link records as JSON lines, in folders by slug and crawl time."""
    links.select(*LINK_COLUMNS, "url_hash", slug, time).write.mode("append").partitionBy(slug, time).option("ignoreNullFields", False).json(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The landed link records; slug and time come from the folders."""
    return spark.read.schema(LINK_SCHEMA + ", keyword_slug string, crawl_ts string").json(path)


def write_wide_csv(wide: DataFrame, path: str, compression: str = "gzip") -> None:
    """CSV with a header line; quotes inside are doubled, so line breaks and quotes survive. Files are compressed (they can't be
    split in any case, since texts hold line breaks); "none" leaves them plain."""
    wide.write.option("compression", compression).option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("nullValue", None).csv(path)


def read_wide_csv(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_records(wide: DataFrame, path: str, date: str) -> None:
    """Job records as Parquet in folders by date."""
    wide.write.mode("append").partitionBy(date).parquet(path)


def append_jobs(wide: DataFrame, url: str, table: str, options: dict[str, str] | None = None) -> None:
    """title, company, location, description and posted_date into a relational table."""
    relational(wide).write.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).mode("append").save()


def append_jobs_once(wide: DataFrame, url: str, table: str, batch_id: str, options: dict[str, str] | None = None) -> bool:
    """As append_jobs, but a batch that comes again adds nothing (False then). Tasks write to a staging table of the batch; one
    transaction notes the batch (by a hash of its id) in the ledger `<table>_batches` and moves its rows."""
    spark, more = wide.sparkSession, options or {}
    digest = hashlib.sha256(batch_id.encode()).digest()
    number, staging, ledger = int.from_bytes(digest[:8], "big", signed=True), f"{table}_{digest.hex()[:12]}", f"{table}_batches"
    save = lambda df, name, mode: df.write.format("jdbc").option("url", url).option("dbtable", name).options(**more).mode(mode).save()
    rows = relational(wide)
    for name, none in ((ledger, spark.createDataFrame([], "batch long, batch_id string")), (table, rows.limit(0))):
        save(none, name, "append")  # makes the table if there is none
    noted = spark.read.format("jdbc").option("url", url).option("dbtable", ledger).options(**more).load()
    if not noted.where(F.col("batch") == number).isEmpty():
        return False
    save(rows, staging, "overwrite")
    names = ", ".join(f'"{c}"' for c in rows.columns)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        statement.executeUpdate(f"LOCK TABLE {ledger} IN EXCLUSIVE MODE")
        held = statement.executeQuery(f'SELECT COUNT(*) FROM {ledger} WHERE "batch" = {number}')
        held.next()
        fresh = held.getInt(1) == 0
        held.close()
        if fresh:
            mark = connection.prepareStatement(f'INSERT INTO {ledger} ("batch", "batch_id") VALUES ({number}, ?)')
            mark.setString(1, batch_id)
            mark.executeUpdate()
            statement.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}")
        connection.commit()
        statement.executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
        return fresh
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE_SCHEMA).parquet(path)


def write_queue(rows: DataFrame, path: str) -> None:
    append(rows.select(*QUEUE_COLUMNS), path)


def read_queue_buckets(spark: SparkSession, path: str, n: int = buckets.BUCKETS) -> DataFrame:
    """A queue that lies in buckets by hash."""
    return buckets.read(spark, path, QUEUE_SCHEMA, "hash_value", n)


def enqueue_in_buckets(links: DataFrame, path: str, now: str, source: str, *order: str, n: int = buckets.BUCKETS) -> None:
    """Add the new links to a queue in buckets. The queue is joined where it lies: only the links are shuffled."""
    held, dealt = read_queue_buckets(links.sparkSession, path, n), links.repartition(n, "hash_value")
    buckets.append(enqueue(held, dealt, now, source, *order), path, QUEUE_SCHEMA, "hash_value", n)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """A whole table under a new version folder; the folder that is being read is never overwritten."""
    path = f"{root.rstrip('/')}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
