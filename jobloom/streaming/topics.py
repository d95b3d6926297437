"""Streams with state of their own: the state of topics, and the first record of each key in a window.

Both are stateful processors with event-time timers, so their state leaves with the watermark. They need the RocksDB state
store (`rocksdb` sets it for a session).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MILLI = 1000
NAT = -(1 << 63)  # numpy's value for no time
TOPIC_STATE = "topic_id long, status string, acquired_at timestamp, seen_at timestamp, n_events long"
SPAN, KEY, DEAL = "span__", "key__", "deal__"  # Spark renames columns that begin with _ on their way to a processor
DEALS = 64  # groups of keys: a call for each, not for each key


def rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need; for streams that start after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _deal(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DEALS))


class Topic(StatefulProcessor):
    """What decides about a topic, whatever the order in which its events come: its first acquire, its first release and its
    last one, by time and seq. Events of a later batch are merged into these, so a late one counts where it belongs in
    time. A finished topic is forgotten `keep` milliseconds of event time after its last event, or an eighth of that later.

    Topics are dealt into groups by a hash: a call works on the batch's events of all topics of a group and touches the state
    of these topics only."""

    FIELDS = ("acquire", "acquire_seq", "release", "release_seq", "last", "last_seq")

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(f, T.LongType()) for f in (*self.FIELDS, "seen", "n")]
        self.state = handle.getMapState("topics", "topic string", T.StructType([*fields, T.StructField("ok", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states, known, now = {}, self.state.exists(), timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            at = pd.DataFrame({"topic": frame[KEY], "ts": _micros(frame["ts"]), "seq": frame["seq"], "action": frame["action"], "success": frame["success"]}).sort_values(["ts", "seq"], kind="stable")
            sizes = at.groupby("topic", sort=False)["ts"].agg(["size", "max"])
            for topic, n, seen in zip(sizes.index.tolist(), sizes["size"].tolist(), sizes["max"].tolist()):
                if topic not in states:
                    states[topic] = list(self.state.getValue((topic,))) if known and self.state.containsKey((topic,)) else [None] * 7 + [0, None]
                state = states[topic]
                state[6], state[7] = max(seen, state[6] or 0), state[7] + n
            for action, place in (("acquire", 0), ("release", 2)):
                own = at[at["action"] == action]
                low = own.drop_duplicates("topic")
                for topic, *first in zip(low["topic"].tolist(), low["ts"].tolist(), low["seq"].tolist()):
                    state = states[topic]
                    if state[place] is None or first < state[place : place + 2]:
                        state[place : place + 2] = first
                if action == "release":
                    high = own.drop_duplicates("topic", keep="last")
                    for topic, ok, *last in zip(high["topic"].tolist(), high["success"].tolist(), high["ts"].tolist(), high["seq"].tolist()):
                        state = states[topic]
                        if state[4] is None or last >= state[4:6]:
                            state[4:6], state[8] = last, bool(ok)
        done = None  # when the first finished topic of the batch may go
        for topic, state in states.items():
            self.state.updateValue((topic,), tuple(state))
            if state[4] is not None and (done is None or self._due(state) < done):
                done = self._due(state)
        if done is not None:
            done, timers = max(done, now + 1), list(self.handle.listTimers())
            if not timers or done < min(timers) - self.keep // 8:
                for timer in timers:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(done)
        status = [("done" if s[8] else "failed") if s[4] is not None else "in_progress" if s[0] is not None else "pending" for s in states.values()]
        granted = [s[0] if s[0] is not None and (s[2] is None or s[:2] < s[2:4]) else None for s in states.values()]
        stamp = lambda us: pd.Series(np.array([NAT if u is None else u for u in us], np.int64).view("datetime64[us]"))
        ids = pd.array([int(t) if t else None for t in states], "Int64")
        yield pd.DataFrame({"topic_id": ids, "status": status, "acquired_at": stamp(granted), "seen_at": stamp([s[6] for s in states.values()]), "n_events": [s[7] for s in states.values()]})

    def _due(self, state) -> int:
        return state[6] // MILLI + self.keep

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = [(self._due(s), k) for k, s in self.state.iterator() if s[4] is not None]
        for at, k in due:
            if at <= now:
                self.state.removeKey(k)
        if later := [at for at, _ in due if at > now]:
            self.handle.registerTimer(max(min(later), now + self.keep // 8 + 1))  # a group is swept eight times in `keep` at most
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def topic_states(events: DataFrame, late: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """A stream of (topic_id, ts, seq, action, success) to the changed state of each topic, in update mode: what
    queue.topic_states gives over all events so far, in whatever batches and order they came.

    Newer rows of a topic have a greater (seen_at, n_events). Events older than the watermark (`late` behind the newest) are
    dropped by Spark, so `late` must cover what may come late; they are counted in the query's progress. Topics without a
    time, or with other actions only, stay pending."""
    rows = events.where("ts is not null").withWatermark("ts", late).withColumn(KEY, F.coalesce(F.col("topic_id").cast("string"), F.lit("")))
    return rows.withColumn(DEAL, _deal(KEY)).groupBy(DEAL).transformWithStateInPandas(Topic(keep_ms), outputStructType=TOPIC_STATE, outputMode="Update", timeMode="EventTime")


class FirstOfWindow(StatefulProcessor):
    """The first record of each key in a window of time; records that come when their window has been closed are flagged late.
    A call works on the batch's records of a window and a group of keys."""

    def __init__(self, time: str, span: int):
        self.time, self.span = time, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "key string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        close = int(key[-1]) + self.span
        if timerValues.getCurrentWatermarkInMs() >= close:
            for frame in rows:
                yield self._flagged(frame, True)
            return
        held = {k for (k,) in self.seen.keys()} if self.seen.exists() else set()
        first = None
        for frame in rows:
            fresh = frame[~frame[KEY].isin(held)]
            fresh = fresh if first is None else pd.concat([first, fresh])
            first = fresh.sort_values(self.time, kind="stable").drop_duplicates(KEY)
        if first is None or first.empty:
            return
        for k in first[KEY].tolist():
            self.seen.updateValue((k,), (True,))
        if not held:
            self.handle.registerTimer(close)
        yield self._flagged(first, False)

    def _flagged(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        return rows.drop(columns=[SPAN, KEY, DEAL], errors="ignore").assign(late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def first_of_window(stream: DataFrame, keys: list[str], time: str, window_ms: int, late: str) -> DataFrame:
    """The first record of each key in each window of `window_ms` (from 1970 on), with `late` false; and, with `late` true,
    every record that came after the watermark (`late` behind the newest record) had passed its window, so that none is lost.

    State is a flag for each key (by its JSON text) and open window. Which record of a window counts is the earliest of the batch that brings
    the first one. Records without a time have no window and go."""
    marked = stream.where(F.col(time).isNotNull()).withWatermark(time, late)
    # The time as a column of its own: were it the marked one, Spark would drop the late records itself.
    own = marked.withColumn(time, F.timestamp_micros(F.unix_micros(time))).withColumn(SPAN, F.unix_millis(time) - F.pmod(F.unix_millis(time), F.lit(window_ms)))
    out = T.StructType([*[f for f in own.schema.fields if f.name != SPAN], T.StructField("late", T.BooleanType())])
    own = own.withColumn(KEY, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).withColumn(DEAL, _deal(KEY))
    return own.groupBy(DEAL, SPAN).transformWithStateInPandas(FirstOfWindow(time, window_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


def kept_and_late(kept: str, late: str):
    """A batch function for first_of_window: records to `kept`, late ones to `late`, each as Parquet in a folder by batch, so a
    repeated batch replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, rows in ((kept, batch.where("not late")), (late, batch.where("late"))):
            rows.drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return write
