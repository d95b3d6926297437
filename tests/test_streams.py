"""Streams in several batches equal the batch job over everything, in whatever order and however often the batches come."""

import datetime as dt
import random
from pathlib import Path

import pandas as pd
import pytest

from jobloom.operators import queue
from jobloom.operators.versions import split
from jobloom.sources import buckets
from jobloom.sources.folders import exists, listed, shared_dir
from jobloom.streaming import streams, topics
from jobloom.streaming.current import VersionTable

SCHEMA = "topic_id long, ts timestamp, seq long, action string, success boolean"
ROW = "url_hash string, seen_at int, v string"


def minute(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    """Process what has landed; the progress of its batches."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def tuples(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# Topics.


def topic_run(spark, batches, late="10 days", keep=30 * 86_400_000):
    topics.rocksdb(spark)
    path, out, mark = (shared_dir(spark, n) for n in ("in", "out", "mark"))
    store, seen = VersionTable(out, topics.TOPIC_STATE, "topic_id", ("seen_at", "n_events"), 2), []
    for rows in batches:
        land(spark, path, rows, SCHEMA)
        seen += run(topics.topic_states(streams.files(spark, path, SCHEMA), late, keep).writeStream.foreachBatch(store.add).option("checkpointLocation", mark).outputMode("update"))
    return store.current(spark).select("topic_id", "status", "acquired_at"), seen


def test_topic_events_of_a_later_batch_count_where_they_belong_in_time(spark):
    first = [(1, minute(5), 0, "release", True), (2, minute(1), 1, "acquire", None), (3, minute(2), 2, "release", True), (5, minute(1), 9, "view", None)]
    second = [(1, minute(1), 3, "acquire", None), (1, minute(3), 4, "release", False), (2, minute(4), 5, "release", False), (3, minute(5), 6, "acquire", None), (4, minute(6), 7, "acquire", None), (3, None, 8, "acquire", None)]
    got, _ = topic_run(spark, [first, second])
    want = queue.topic_states(spark.createDataFrame([r for r in first + second if r[1]], SCHEMA))
    assert tuples(got) == tuples(want) and tuples(got)[0] == (1, "done", minute(1))


def test_topic_events_in_any_order(spark):
    rnd = random.Random(7)
    events = [(rnd.randrange(6), minute(rnd.randrange(40)), k, rnd.choice(["acquire", "release"]), rnd.random() < 0.5) for k in range(60)]
    rnd.shuffle(events)
    got, _ = topic_run(spark, [events[:20], events[20:40], events[40:]])
    assert tuples(got) == tuples(queue.topic_states(spark.createDataFrame(events, SCHEMA)))


def test_a_call_takes_all_topics_of_a_group():
    """With a call for each topic, 6 GB of events were projected to take longer than their time."""
    topic, handle = topics.Topic(8000), Handle()
    topic.init(handle)
    time = lambda s: pd.Timestamp(s, unit="s")
    frame = lambda *rows: pd.DataFrame([(str(k), time(s), n, a, ok) for n, (k, s, a, ok) in enumerate(rows)], columns=[topics.KEY, "ts", "seq", "action", "success"])
    call = lambda mark, *frames: {r[0]: tuple(None if pd.isna(x) else x for x in r[1:]) for f in topic.handleInputRows((0,), iter(frames), at(mark)) for r in f.itertuples(index=False)}
    first = call(0, frame((1, 5, "acquire", None), (2, 9, "release", False), (1, 4, "acquire", None)), frame((3, 2, "release", True), (2, 1, "acquire", None), (2, 9, "release", True)))
    assert first == {1: ("in_progress", time(4), time(5), 2), 2: ("done", time(1), time(9), 3), 3: ("done", None, time(2), 1)}
    assert handle.timers == [10_000] and handle.asked == 0
    assert call(0, frame((1, 20, "release", False), (3, 1, "acquire", None))) == {1: ("failed", time(4), time(20), 3), 3: ("done", time(1), time(2), 2)}
    assert handle.asked == 2  # of the topics of the batch, not of all
    handle.timers.clear()
    list(topic.handleExpiredTimer((0,), at(10_000), None))
    assert set(handle.held) == {("1",), ("2",)} and handle.timers == [17_000]
    list(topic.handleExpiredTimer((0,), at(28_000), None))
    assert not handle.held


def test_finished_topics_leave_the_state(spark):
    done = [(k, minute(0), k, "release", True) for k in range(20)] + [(99, minute(0), 99, "acquire", None)]
    got, seen = topic_run(spark, [done, [(50, minute(600), 100, "acquire", None)], [(51, minute(601), 101, "acquire", None)]], "10 minutes", 3_600_000)
    rows = [sum(o.customMetrics.get("numDeletedStateVars", 0) for o in p.stateOperators) for p in seen]
    assert seen[0].stateOperators[0].numRowsTotal > seen[-1].stateOperators[0].numRowsTotal or sum(rows) > 0
    assert seen[-1].stateOperators[0].numRowsTotal <= 10  # three open topics and their bookkeeping, not the twenty that are done
    assert len(tuples(got)) == 23  # the table keeps them


# Distinct records.


def test_windows_leave_the_state_and_late_records_are_kept_apart(spark):
    topics.rocksdb(spark)
    path, kept, late, mark = (shared_dir(spark, n) for n in ("in", "kept", "late", "mark"))
    schema, sizes = "k string, ts timestamp, v int", []
    batches = [[(f"k{n}", minute(n % 50), n) for n in range(60)] + [("a", minute(1), 1), ("a", minute(0), 0)], [("b", minute(500), 2)], [("a", minute(2), 3), ("a", minute(3), 4), ("b", minute(499), 5), (None, minute(501), 6), ("n", None, 7)]]
    for rows in batches:
        land(spark, path, rows, schema)
        first = topics.first_of_window(streams.files(spark, path, schema), ["k"], "ts", 3_600_000, "10 minutes")
        sizes += [p.stateOperators[0].numRowsTotal for p in run(first.writeStream.foreachBatch(topics.kept_and_late(kept, late)).option("checkpointLocation", mark))]
    a = [r for r in tuples(spark.read.parquet(kept), "k", "ts", "v") if r[0] == "a"]
    assert a == [("a", minute(0), 0)] and tuples(spark.read.schema(schema).parquet(late), "k", "ts", "v") == [("a", minute(2), 3), ("a", minute(3), 4)]
    assert spark.read.parquet(kept).count() == 60 + 1 + 1 + 1 and sizes[-1] <= 6 < 60 < max(sizes)


class Handle:
    """What a processor asks of its handle, for one group, in memory."""

    def __init__(self):
        self.held, self.timers, self.asked = {}, [], 0

    def getMapState(self, name, key, value):
        return self

    exists = lambda self: bool(self.held)
    keys = lambda self: iter(self.held)
    iterator = lambda self: iter(list(self.held.items()))
    clear = lambda self: self.held.clear()
    removeKey = lambda self, key: self.held.pop(key)
    updateValue = lambda self, key, value: self.held.update({key: value})
    listTimers = lambda self: iter(self.timers)
    registerTimer = lambda self, at: self.timers.append(at)
    deleteTimer = lambda self, at: self.timers.remove(at)

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        return self.held[key]


def at(watermark):
    return type("Times", (), {"getCurrentWatermarkInMs": lambda self: watermark})()


def test_a_call_takes_all_keys_of_a_window():
    """With a call for each key, 1 GB of events took longer than its time."""
    first, handle = topics.FirstOfWindow("ts", 3_600_000), Handle()
    first.init(handle)
    frame = lambda *rows: pd.DataFrame([(k, pd.Timestamp(minute(m)), k) for k, m in rows], columns=["k", "ts", topics.KEY])
    call = lambda mark, *frames: [tuple(r) for f in first.handleInputRows((0, 0), iter(frames), at(mark)) for r in f[["k", "ts", "late"]].itertuples(index=False)]
    assert sorted(call(0, frame(("a", 3), ("b", 2), ("a", 1)), frame(("c", 5), ("b", 1)))) == [("a", minute(1), False), ("b", minute(1), False), ("c", minute(5), False)]
    assert call(0, frame(("a", 0), ("d", 4))) == [("d", minute(4), False)] and handle.timers == [3_600_000]
    assert call(3_600_000, frame(("a", 0), ("e", 4))) == [("a", minute(0), True), ("e", minute(4), True)]


def test_built_in_windows_have_bounded_state(spark):
    path, mark, out, schema = shared_dir(spark, "in"), shared_dir(spark, "mark"), shared_dir(spark, "out"), "k string, ts timestamp"
    sizes = []
    for day in range(6):
        land(spark, path, [(f"k{n % 30}", minute(1440 * day + n)) for n in range(60)], schema)
        one = streams.distinct_in_windows(streams.files(spark, path, schema), ["k"], "ts", "1 day", "2 hours")
        sizes += [p.stateOperators[0].numRowsTotal for p in run(one.writeStream.foreachBatch(streams.unseen_to(out, "k string", "k", 2)).option("checkpointLocation", mark))]
    assert max(sizes) <= 90 and sizes[-1] <= 60  # two open windows, and one that is about to be closed, of six
    assert tuples(buckets.read(spark, out, "k string", "k", 2)) == sorted((f"k{n}",) for n in range(30))


# Versions.


def stream_into(spark, store, path, mark):
    return run(streams.files(spark, path, ROW, 1).writeStream.foreachBatch(store.add).option("checkpointLocation", mark))


def want(spark, rows):
    now, past = split(spark.createDataFrame(list(set(rows)), ROW), "url_hash", "seen_at")
    return tuples(now), tuples(past)


@pytest.mark.parametrize("folds", [(), (0,), (1,), (0, 1, 2)])
def test_current_and_history_over_batches_folds_and_a_lost_checkpoint(spark, folds):
    path, mark, again = (shared_dir(spark, n) for n in ("in", "mark", "mark"))
    store = VersionTable(shared_dir(spark, "cur"), ROW, "url_hash", ("seen_at",), 2)
    batches = [[("a", 1, "x"), ("b", 1, "y"), ("n", None, "null first")], [("a", 3, "z"), ("c", 1, "w"), ("n", 0, "later")], [("a", 2, "late"), ("b", 5, "up"), ("c", 0, "older"), ("c", 1, "w")]]
    for k, rows in enumerate(batches):
        land(spark, path, rows, ROW)
        stream_into(spark, store, path, mark)
        if k in folds:
            assert store.compact(spark) == folds.index(k)
        assert (tuples(store.current(spark)), tuples(store.history(spark))) == want(spark, sum(batches[: k + 1], []))
    stream_into(spark, store, path, again)  # everything again, as other batches of another query
    assert (tuples(store.current(spark)), tuples(store.history(spark))) == want(spark, sum(batches, []))
    store.compact(spark)
    store.vacuum(spark, 0)
    assert (tuples(store.current(spark)), tuples(store.history(spark))) == want(spark, sum(batches, []))
    assert listed(spark, f"{store.root}/changes") == [] and len(listed(spark, f"{store.root}/base")) == 1


def test_half_written_changes_and_folds_dont_count(spark):
    store = VersionTable(shared_dir(spark, "cur"), ROW, "url_hash", ("seen_at",), 2)
    rows = lambda *r: spark.createDataFrame(list(r), ROW)
    store.add(rows(("a", 1, "x"), (None, 1, "no key")), 0)
    store.compact(spark)
    store.add(rows(("a", 2, "y")), 1)
    Path(f"{store.root.removeprefix('file:').replace('//', '/')}/changes/b=none-{1:012d}/_SUCCESS").unlink()
    assert tuples(store.current(spark)) == [("a", 1, "x")]  # not completed
    store.add(rows(("a", 2, "y")), 1)  # the batch runs again
    assert tuples(store.current(spark)) == [("a", 2, "y")] and tuples(store.history(spark)) == [("a", 1, "x")]
    store.compact(spark)
    Path(f"{store.root.removeprefix('file:').replace('//', '/')}/base/v={1:08d}/_DONE").unlink()  # the fold was cut off
    assert tuples(store.current(spark)) == [("a", 2, "y")] and tuples(store.history(spark)) == [("a", 1, "x")]
    assert store.compact(spark) == 1 and tuples(store.history(spark)) == [("a", 1, "x")] and tuples(store.current(spark)) == [("a", 2, "y")]
    assert store.compact(spark) == 1  # nothing to fold


def test_a_batch_writes_in_proportion_to_itself(spark):
    store = VersionTable(shared_dir(spark, "cur"), ROW, "url_hash", ("seen_at",), 2)
    many = spark.range(20_000).selectExpr("cast(id as string) url_hash", "1 seen_at", "repeat(sha2(cast(id as string), 256), 2) v")
    store.add(many, 0)
    store.compact(spark)
    root = Path("/" + store.root.removeprefix("file:").lstrip("/"))
    size = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    before = size()
    store.add(many.limit(20).selectExpr("url_hash", "2 seen_at", "v"), 1)
    assert 0 < size() - before < 50_000 < before


def test_the_base_is_joined_where_it_lies(spark):
    store = VersionTable(shared_dir(spark, "cur"), ROW, "url_hash", ("seen_at",), 2)
    for k in range(3):
        store.add(spark.createDataFrame([("a", k, "x")], ROW), k)
        if k < 2:
            store.compact(spark)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (store.current(spark), store.history(spark)):
            assert not moved(df, "Bucketed: true")
        links = spark.createDataFrame([("a", 1)], "url_hash string, n int")
        out = shared_dir(spark, "seen")
        buckets.append(links, out, "url_hash string, n int", "url_hash", 3)
        assert not moved(queue.unknown(links, buckets.read(spark, out, "url_hash string, n int", "url_hash", 3), key="url_hash"), "Bucketed: true")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def moved(df, scan):
    """Whether the rows of a scan are moved before the join that they take part in."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = False
    for k, line in enumerate(plan):
        if scan in line:
            found, level = True, depth(line)
            for up in reversed(plan[:k]):
                if depth(up) < level:
                    level = depth(up)
                    if "Exchange" in up:
                        return True
                    if "Join" in up:
                        break
    assert found
    return False


def test_bad_json_is_dropped(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("no",), (None,)], "value string")
    assert [r.a for r in streams.records(rows, "a int").where("a is not null").collect()] == [1]


def test_a_finished_file_appears_whole(spark):
    from jobloom.sources.folders import read_lines, write_lines

    path = shared_dir(spark, "names")
    write_lines(spark, f"{path}/x", ["ä", "b"])
    assert read_lines(spark, f"{path}/x") == ["ä", "b"] and listed(spark, path) == ["x"] and not exists(spark, f"{path}/y") and listed(spark, f"{path}/none") == []
