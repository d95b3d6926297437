"""Objects under keys, topics in files, batches that can be repeated, dated records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobloom.operators import queue
from jobloom.operators.wide import WIDE_COLUMNS
from jobloom.sources import objects, tables as io, topic_log
from jobloom.sources.folders import listed, shared_dir
from jobloom.streaming import streams

WIDE = ", ".join(f"{c} string" for c in WIDE_COLUMNS)
DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def tuples(df):
    return sorted(map(tuple, df.collect()))


def test_objects_leave_exactly_the_named_keys(spark):
    path = shared_dir(spark, "bucket")
    rows = [("a.txt", "việc làm"), ("deep/er/b c+d%.txt", "x\ny"), ("empty", None)]
    objects.put_objects(spark.createDataFrame(rows, "key string, text string"), path)
    assert tuples(objects.get_objects(spark, path)) == sorted((k, t or "") for k, t in rows) and listed(spark, path) == ["a.txt", "deep", "empty"]
    objects.put_objects(spark.createDataFrame([("a.txt", "new")], "key string, text string"), path)
    assert ("a.txt", "new") in tuples(objects.get_objects(spark, path))


@pytest.mark.parametrize("rows", [[("x", "1"), ("../out", "2")], [("x", "1"), ("x", "2")], [("x", "1"), ("", "2")], [("y", "1"), ("kept", "2")]])
def test_a_failed_write_leaves_nothing(spark, rows):
    path = shared_dir(spark, "bucket")
    objects.put_objects(spark.createDataFrame([("kept", "old")], "key string, text string"), path)
    with pytest.raises(Exception):
        objects.put_objects(spark.createDataFrame(rows, "key string, text string").repartition(2), path, overwrite=False)
    assert tuples(objects.get_objects(spark, path)) == [("kept", "old")] and listed(spark, path) == ["kept"]


def test_topics_have_offsets_limits_and_restarts(spark):
    path, out, mark = (shared_dir(spark, n) for n in ("topic", "out", "mark"))
    values = spark.range(40).selectExpr("id % 5 k", 'concat(\'{"id": \', id, \'}\') value')
    sizes = []

    def step(most):
        q = streams.records(topic_log.subscribe(spark, path, most, "g"), "id long").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(sum(p.numInputRows for p in q.recentProgress))

    topic_log.publish(values.where("id < 20"), path, 2, "k")
    step(6)
    step(6)
    topic_log.publish(values.where("id >= 20"), path, 2, "k")
    assert sizes == [6, 6] and sum(topic_log.ends(path).values()) == 40
    while sizes[-1]:
        step(0)
    assert sum(sizes) == 40 and [r.id for r in spark.read.parquet(out).orderBy("id").collect()] == list(range(40))
    found = topic_log.files(path)
    assert all(x[k][1] == x[k + 1][0] for x in found.values() for k in range(len(x) - 1)) and all(x[0][0] == 0 for x in found.values())


def test_relational_batches_count_once(spark):
    url, df = "jdbc:derby:memory:once;create=true", spark.createDataFrame([("t", None, *["x"] * 23), ("u", *["y"] * 24)], WIDE)
    read = lambda: spark.read.format("jdbc").option("url", url).option("dbtable", "jobs").options(**DERBY).load()
    assert io.append_jobs_once(df, url, "jobs", "day 1", DERBY) and not io.append_jobs_once(df, url, "jobs", "day 1", DERBY)
    assert read().count() == 2
    assert io.append_jobs_once(df.limit(1), url, "jobs", "day 2", DERBY) and read().count() == 3
    assert {tuple(r) for r in read().select("title", "company").collect()} >= {("t", "x"), ("y", "y")}


def test_records_by_date(spark):
    path = shared_dir(spark, "records")
    df = spark.createDataFrame([("t", *["x"] * 24), (None, *["y"] * 24)], WIDE)
    for day in ("2024-01-01", "2024-01-02"):
        io.write_records(df.withColumn("date", F.lit(day)), path, "date")
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.where("date = DATE '2024-01-02'").drop("date").columns == WIDE_COLUMNS and listed(spark, path)[1:] == ["date=2024-01-01", "date=2024-01-02"]


def test_log_in_stretches_equals_the_log_at_once(spark):
    d = dt.datetime(2025, 1, 1)
    log = [(f"u{k % 4}", d + dt.timedelta(minutes=k * 7 % 60), f"e{k}", "30" if k % 5 == 0 else None, k) for k in range(23)]
    df = spark.createDataFrame(log, "url string, ts timestamp_ntz, error string, retry_after string, n int")
    parts = [queue.attempt_counts(df.where(F.col("n") % 3 == k), "url", "ts", "n") for k in (2, 0, 1)]
    assert tuples(queue.scheduled(queue.merged_counts(queue.merged_counts(*parts[:2]), parts[2]))) == tuples(queue.retries(df, "url", "ts", "n"))


def test_wide_csv_is_written_small(spark):
    from jobloom.operators.wide import WIDE_COLUMNS
    from jobloom.sources import tables
    from jobloom.sources.folders import listed, shared_dir

    path = shared_dir(spark, "csv")
    rows = spark.range(2000).selectExpr(*[f"'line \"one\",\n two' as {c}" if k else f"cast(id as string) as {c}" for k, c in enumerate(WIDE_COLUMNS)]).coalesce(1)
    tables.write_wide_csv(rows, path)
    names = [n for n in listed(spark, path) if n.startswith("part-")]
    size = spark.read.format("binaryFile").load(path).selectExpr("sum(length)").first()[0]
    assert all(n.endswith(".csv.gz") for n in names) and size < 100_000
    assert sorted(map(tuple, tables.read_wide_csv(spark, path).collect())) == sorted(map(tuple, rows.collect()))
