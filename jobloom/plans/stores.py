"""Queries that write and read again: keyword lists, landed pages, link files, CSV, the queue; and the streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.urls import url_hash
from ..operators import queue
from ..sources import buckets, objects, tables as io, topic_log
from ..sources.folders import shared_dir
from ..streaming import streams, topics
from ..streaming.current import VersionTable
from .tables import HASH_SQL, NEW_SQL, RETRY_SQL, TOPIC_SQL, VERSION_SQL, WIDE_SQL, _fetch_log, _records, _wide, table, topic_events

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def keyword_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as keyword lists, a file for each brand; blank lines and spaces around are dropped."""
    path = shared_dir(spark, "lists")
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit("\n  "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("\t")).alias("value"))
    lines.write.text(path)
    return io.read_keyword_lists(spark, path).select("keyword")


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "landed")
    io.append(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return io.read_pages(spark, path).select("page_id", "url", F.sha2("html", 256).alias("html_sha256"))


def links_json_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as link records through JSON lines in folders by slug and time."""
    path = shared_dir(spark, "links")
    none = F.lit(None).cast("string")
    p = table(spark, sf_dir, "pages")
    rows = p.select(F.concat(F.lit("Trang \""), "page_id", F.lit("\"\n")).alias("title"), F.col("url").alias("job_url"), *[none.alias(c) for c in ("company", "company_url", "salary_list", "address_list", "exp_list")],
                    url_hash("url").alias("url_hash"), F.concat(F.lit("kw-"), (F.col("page_id") % 3).cast("string")).alias("keyword_slug"), F.lit("20240101102030").alias("crawl_ts"))
    io.write_links(rows, path)
    return io.read_links(spark, path).select("title", "job_url", "company", "url_hash", "keyword_slug", "crawl_ts")


LINKS_SQL = f"""SELECT 'Trang "' || page_id || '"' || chr(10) AS title, url AS job_url, CAST(NULL AS VARCHAR) AS company, {HASH_SQL} AS url_hash, 'kw-' || (page_id % 3) AS keyword_slug, '20240101102030' AS crawl_ts FROM pages"""


def wide_csv_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV doesn't tell an empty text from a null: both come back as null."""
    path = shared_dir(spark, "wide-csv")
    io.write_wide_csv(_wide(spark, sf_dir), path)
    return io.read_wide_csv(spark, path)


def queue_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls enqueue their links; the second adds only new hashes."""
    path = shared_dir(spark, "queue")
    p = table(spark, sf_dir, "pages").select("page_id", "url", url_hash("url").alias("hash_value"))
    empty = spark.createDataFrame([], io.QUEUE_SCHEMA)
    io.write_queue(queue.enqueue(empty, p.where("page_id % 2 = 0"), "2024-01-01 00:00:00", "a", "page_id"), path)
    io.write_queue(queue.enqueue(io.read_queue(spark, path), p, "2024-01-02 00:00:00", "b", "page_id"), path)
    return io.read_queue(spark, path).select("url", "hash_value", "status", "source", "created_at")


QUEUE_SQL = f"""WITH p AS (SELECT page_id, url, {HASH_SQL} AS h FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id % 2, page_id) AS n FROM p WHERE h IS NOT NULL)
SELECT url, h AS hash_value, 'pending' AS status, CASE page_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS source, CASE page_id % 2 WHEN 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS created_at FROM r WHERE n = 1"""


def topic_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pending topics (some failed): a batch is claimed, and its even ids are released."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.expr("c_custkey % 4 = 0"), "failed").otherwise("pending").alias("status"))
    taken, held = queue.claim(c, 60)
    return queue.release(held, taken.where("id % 2 = 0").select("id", (F.col("id") % 3 > 0).alias("success")))


CLAIM_SQL = """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'pending' END AS status FROM customer), t AS (SELECT id FROM c WHERE status = 'pending' ORDER BY id LIMIT 60)
SELECT c.id, CASE WHEN t.id IS NULL THEN status WHEN c.id % 2 = 1 THEN 'in_progress' WHEN c.id % 3 > 0 THEN 'done' ELSE 'failed' END AS status FROM c LEFT JOIN t ON c.id = t.id"""


# Streams: the events table as a stream of files.


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a batch."""
    path = shared_dir(spark, "event-files")
    table(spark, sf_dir, "events").repartitionByRange(3, "ts").write.parquet(path)
    return streams.files(spark, path, EVENTS, 1)


def _run(spark: SparkSession, sf_dir: str, shuffled: bool, start: Callable[[DataFrame], DataStreamWriter], between: Callable[[int], None] = lambda k: None) -> str:
    """Run a stream of the events in three batches, one for each stretch of time, or dealt out whatever their time: it goes on
    from its checkpoint each time that the next batch has landed. The folder of the events."""
    path, events = shared_dir(spark, "event-files"), table(spark, sf_dir, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return path
    cut = F.expr("pmod(hash(event_id), 3)") if shuffled else F.when(F.col("ts") < low + (high - low) / 3, 0).when(F.col("ts") < low + (high - low) * 2 / 3, 1).otherwise(2)
    for k in range(3):
        events.where(cut == k).write.mode("append").parquet(path)
        streams.run_available(start(streams.files(spark, path, EVENTS)))
        between(k)
    return path


def stream_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON values, parsed and written by date, then read back."""
    path, mark = shared_dir(spark, "records"), shared_dir(spark, "mark")
    e = _event_stream(spark, sf_dir)
    values = e.select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("date"))).alias("value"))
    parsed = streams.records(values, "event_id long, user_id long, event_type string, value double, date string")
    streams.run_available(streams.to_parquet(parsed, path, mark, "date"))
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "value", F.col("date").cast("string").alias("date"))


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, kind) of the stream: within days by state that leaves after two hours, over all days by a table in
    buckets that holds the keys seen before."""
    path, mark, schema = shared_dir(spark, "distinct"), shared_dir(spark, "mark"), "seen string, user_id long, event_type string"

    def start(events: DataFrame) -> DataStreamWriter:
        own = _timed(events).withColumn("seen", F.concat_ws("/", "user_id", "event_type"))
        return streams.distinct_in_windows(own, ["seen"], "ts", "1 day", "2 hours").writeStream.foreachBatch(streams.unseen_to(path, schema, "seen", 8)).option("checkpointLocation", mark)

    _run(spark, sf_dir, False, start)
    return buckets.read(spark, path, schema, "seen", 8).drop("seen")


def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day from batches in no order, with a watermark of two days: the first event of a window, and the late events
    from their own table, which together miss none."""
    kept, late, mark = (shared_dir(spark, n) for n in ("kept", "late", "mark"))
    topics.rocksdb(spark)

    def start(events: DataFrame) -> DataStreamWriter:
        first = topics.first_of_window(_timed(events).select("user_id", "ts"), ["user_id"], "ts", 86_400_000, "2 days")
        return first.writeStream.foreachBatch(topics.kept_and_late(kept, late)).option("checkpointLocation", mark)

    _run(spark, sf_dir, True, start)
    day = lambda path: spark.read.schema("user_id long, ts timestamp").parquet(path).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return day(kept).unionByName(day(late)).distinct()


def stream_topic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic states from batches in no order; `late` covers the table."""
    root, mark = shared_dir(spark, "topics"), shared_dir(spark, "mark")
    topics.rocksdb(spark)
    store = VersionTable(root, topics.TOPIC_STATE, "topic_id", ("seen_at", "n_events"), 8)
    low, high = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    span = f"{1 if low is None else (high - low).days + 1} days"

    def start(events: DataFrame) -> DataStreamWriter:
        states = topics.topic_states(topic_events(_timed(events)), span)
        return states.writeStream.foreachBatch(store.add).option("checkpointLocation", mark).outputMode("update")

    _run(spark, sf_dir, True, start)
    return store.current(spark).select("topic_id", "status", F.col("acquired_at").cast("timestamp_ntz").alias("acquired_at"))


RECORDS = "url_hash string, seen_at timestamp_ntz, event_id long, event_type string, value double"


def _versions(spark: SparkSession, sf_dir: str) -> VersionTable:
    """Events as records of jobs: folded into the base after the second batch; then the stream loses its checkpoint and reads
    everything again."""
    store = VersionTable(shared_dir(spark, "versions"), RECORDS, "url_hash", ("seen_at", "event_id"), 8)
    first, again = shared_dir(spark, "mark"), shared_dir(spark, "mark")
    to = lambda mark: lambda e: _records(e).writeStream.foreachBatch(store.add).option("checkpointLocation", mark)
    path = _run(spark, sf_dir, True, to(first), lambda k: store.compact(spark) if k == 1 else None)
    streams.run_available(to(again)(streams.files(spark, path, EVENTS)))
    return store


def stream_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).current(spark)


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).history(spark)


# Topics, objects, retries over stretches of the log.


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON through a topic of three partitions: published in two parts, read by batches of a bounded number of
    offsets, with a restart after each."""
    path, out, mark = (shared_dir(spark, n) for n in ("topic", "records", "mark"))
    events = table(spark, sf_dir, "events")
    values = events.select("user_id", "event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("date"))).alias("value"))
    most = max(1, events.count() // 3)
    for part in (0, 1):
        topic_log.publish(values.where(F.col("event_id") % 2 == part), path, 3, "user_id")
        while True:
            stream = topic_log.subscribe(spark, path, most, "records")
            parsed = streams.records(stream, "event_id long, user_id long, event_type string, value double, date string")
            q = streams.to_parquet(parsed, out, mark, "date").trigger(availableNow=True).start()
            q.awaitTermination()
            if not sum(p.numInputRows for p in q.recentProgress):
                break
    return spark.read.schema("event_id long, user_id long, event_type string, value double, date string").parquet(out)


def objects_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page under a key of its own, written and read back."""
    path = shared_dir(spark, "bucket")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("html/"), F.col("page_id") % 7, F.lit("/page "), "page_id", F.lit("+.html")).alias("key"), F.col("html").alias("text"))
    objects.put_objects(p, path)
    return objects.get_objects(spark, path).select("key", F.sha2("text", 256).alias("text_sha256"))


def retry_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log in three stretches, in no order of time: counts of each are kept and merged with those before."""
    log, state = _fetch_log(spark, sf_dir), None
    for k in (2, 0, 1):
        counts = queue.attempt_counts(log.where(F.dayofmonth("ts") % 3 == k), "url", "ts", "event_id")
        path = shared_dir(spark, "attempts")
        (queue.merged_counts(state, counts) if state else counts).write.parquet(path)
        state = spark.read.parquet(path)
    return queue.scheduled(state).select("url", F.col("attempts").cast("long").alias("attempts"), "last_error", "next_try_at", "status")


# The queue in buckets.


def queue_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three crawls enqueue their links in a queue that lies in buckets by hash; only new links move."""
    path = shared_dir(spark, "queue")
    p = table(spark, sf_dir, "pages").select("page_id", "url", url_hash("url").alias("hash_value"))
    for k in range(3):
        io.enqueue_in_buckets(p.where(f"page_id % 3 >= {2 - k}"), path, f"2024-01-0{k + 1} 00:00:00", f"crawl {k}", "page_id")
    return io.read_queue_buckets(spark, path).select("url", "hash_value", "status", "source", "created_at")


IN_BUCKETS_SQL = f"""WITH p AS (SELECT page_id, url, {HASH_SQL} AS h, 2 - page_id % 3 AS k FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY k, page_id) AS n FROM p WHERE h IS NOT NULL)
SELECT url, h AS hash_value, 'pending' AS status, 'crawl ' || k AS source, TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)) AS created_at FROM r WHERE n = 1"""


def new_vs_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of jobs that are in neither the current nor the superseded records, both kept in buckets by hash."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", url_hash("url").alias("url_hash"))
    now, past = shared_dir(spark, "now"), shared_dir(spark, "past")
    for path, k in ((now, 0), (past, 1)):
        buckets.append(p.where(f"page_id % 3 = {k}"), path, "url_hash string, page_id long", "url_hash")
    known = [buckets.read(spark, path, "url_hash string, page_id long", "url_hash") for path in (now, past)]
    return queue.unknown(p.where("page_id % 3 = 2"), *known, key="url_hash")


QUERIES = {
    "keyword_import": keyword_import, "landed_pages": landed_pages, "links_json_io": links_json_io, "wide_csv_io": wide_csv_io, "queue_io": queue_io, "topic_claim": topic_claim,
    "stream_to_parquet": stream_to_parquet, "stream_dedup": stream_dedup, "stream_topic_state": stream_topic_state, "stream_current": stream_current,
    "stream_dedup_late": stream_dedup_late, "stream_history": stream_history, "queue_in_buckets": queue_in_buckets, "new_vs_versions": new_vs_versions,
    "topic_records": topic_records, "objects_by_key": objects_by_key, "retry_stretches": retry_stretches,
}
ORACLE = {
    "keyword_import": "SELECT p_name || ' ' || p_partkey AS keyword FROM part", "landed_pages": "SELECT page_id, url, sha256(html) AS html_sha256 FROM pages", "links_json_io": LINKS_SQL, "wide_csv_io": f"SELECT * REPLACE (nullif(company_url_from_job, '') AS company_url_from_job) FROM ({WIDE_SQL})",
    "queue_io": QUEUE_SQL, "topic_claim": CLAIM_SQL, "stream_to_parquet": "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS date FROM events",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events", "stream_topic_state": TOPIC_SQL, "stream_current": VERSION_SQL.format("= 1"),
    "stream_dedup_late": "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events", "stream_history": VERSION_SQL.format("> 1"), "queue_in_buckets": IN_BUCKETS_SQL, "new_vs_versions": NEW_SQL,
    "topic_records": "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS date FROM events", "retry_stretches": RETRY_SQL,
    "objects_by_key": "SELECT 'html/' || (page_id % 7) || '/page ' || page_id || '+.html' AS key, sha256(coalesce(html, '')) AS text_sha256 FROM pages",
}
