"""The link queue: new links, due links, retries, topic states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

QUEUE_COLUMNS = ["url", "hash_value", "status", "attempts", "last_error", "next_try_at", "created_at", "updated_at", "source"]


def distinct_links(links: DataFrame, *order: str) -> DataFrame:
    """The first link of each hash in order of arrival; links without a hash go."""
    w = Window.partitionBy("hash_value").orderBy(*order)
    return links.where("hash_value is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unknown(links: DataFrame, *states: DataFrame, key: str = "hash_value") -> DataFrame:
    """Links whose key is in none of the states (queue, current jobs, history)."""
    for state in states:
        links = links.join(state.select(key), key, "left_anti")
    return links


def enqueue(queue: DataFrame, links: DataFrame, now: str, source: str, *order: str) -> DataFrame:
    """The rows that links (url, hash_value, ...) add to the queue: new hashes once, pending, with the defaults."""
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    fresh = unknown(distinct_links(links, *order), queue)
    return fresh.select(
        "url", "hash_value", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp_ntz").alias("next_try_at"),
        at.alias("created_at"), at.alias("updated_at"), F.lit(source).alias("source"))


def due(queue: DataFrame, now: str) -> DataFrame:
    """Links to fetch: pending or failed, and their next try not in the future. Links given up have a state of their own."""
    return queue.where(f"status in ('pending', 'failed') and (next_try_at is null or next_try_at <= TIMESTAMP_NTZ '{now}')")


def attempts(log: DataFrame, key: str = "url", *order: str) -> DataFrame:
    """The fetch log with `attempt`: the number of each try of a URL, from 1."""
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(*(order or ("ts",)))))


def attempt_counts(log: DataFrame, key: str = "url", *order: str) -> DataFrame:
    """What a stretch of the fetch log says about each URL: how many tries, and the last of them (ts, error, retry_after).
    Reduced before the shuffle, so a URL with very many tries is no burden."""
    at = F.struct(*(order or ("ts",)))
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max(F.struct(at.alias("at"), "ts", "error", "retry_after")).alias("last"))


def merged_counts(*counts: DataFrame, key: str = "url") -> DataFrame:
    """The counts of several stretches of the log as one, in whatever order they come: a state that grows with the URLs, not
    with the log. A stretch must not be merged twice."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.sum("attempts").alias("attempts"), F.max("last").alias("last"))


def scheduled(counts: DataFrame, key: str = "url", step: int = 6, most: int = 5) -> DataFrame:
    """The state of each URL after its last failed try: attempts, last_error, next_try_at, status.

    The wait is retry_after if it is a whole number, else `step` seconds for each try so far. Up to `most` tries the link is
    failed and due at its next try; after them it is given up (status given_up, no next try) and never due again.
    """
    last = counts.select(key, F.col("attempts").cast("int").alias("attempt"), "last.ts", "last.error", "last.retry_after")
    wait = F.when(F.trim("retry_after").rlike(r"^\d{1,9}$"), F.trim("retry_after").try_cast("int")).otherwise(F.lit(step) * F.col("attempt"))
    up = F.col("attempt") >= most
    return last.withColumn("wait_s", wait).select(
        key, F.col("attempt").alias("attempts"), F.col("error").alias("last_error"), F.when(~up, F.expr("timestampadd(SECOND, wait_s, ts)")).alias("next_try_at"),
        F.when(up, F.lit("given_up")).otherwise(F.lit("failed")).alias("status"))


def retries(log: DataFrame, key: str = "url", *order: str, step: int = 6, most: int = 5) -> DataFrame:
    """As scheduled(), from a whole log of failed tries with ts, error and retry_after."""
    return scheduled(attempt_counts(log, key, *order), key, step, most)


def claim(topics: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the claimed ids, the table with them in progress): n pending topics, smallest id first."""
    taken = topics.where("status = 'pending'").orderBy("id").limit(n).select("id")
    mark = taken.withColumn("__taken", F.lit(True))
    out = topics.join(mark, "id", "left").select(*[F.when(F.col("__taken"), F.lit("in_progress")).otherwise(F.col("status")).alias("status") if c == "status" else c for c in topics.columns])
    return taken, out


def release(topics: DataFrame, done: DataFrame) -> DataFrame:
    """The table with the released topics (id, success) done or failed, whatever their state was."""
    joined = topics.join(done.select("id", F.col("success").alias("__ok")), "id", "left")
    state = F.when(F.col("__ok"), F.lit("done")).when(~F.col("__ok"), F.lit("failed")).otherwise(F.col("status"))
    return joined.select(*[state.alias("status") if c == "status" else c for c in topics.columns])


def topic_states(events: DataFrame) -> DataFrame:
    """Acquire and release events (topic_id, ts, seq, action, success) folded to the state of each topic.

    A topic starts pending; an acquire is granted only then; a release sets done or failed from any state. So the last
    release decides, and an acquire is granted if no release came before the first one.
    """
    at = F.struct("ts", "seq")
    acquire, rel = F.col("action") == "acquire", F.col("action") == "release"
    folded = events.groupBy("topic_id").agg(
        F.min(F.when(acquire, at)).alias("first_acquire"), F.min(F.when(rel, at)).alias("first_release"), F.max_by(F.when(rel, F.col("success")), F.when(rel, at)).alias("ok"), F.max(F.when(rel, at)).alias("last_release"))
    granted = F.col("first_acquire").isNotNull() & (F.col("first_release").isNull() | (F.col("first_acquire") < F.col("first_release")))
    state = F.when(F.col("last_release").isNotNull(), F.when(F.col("ok"), F.lit("done")).otherwise(F.lit("failed"))).when(F.col("first_acquire").isNotNull(), F.lit("in_progress")).otherwise(F.lit("pending"))
    return folded.select("topic_id", state.alias("status"), F.when(granted, F.col("first_acquire.ts")).alias("acquired_at"))
