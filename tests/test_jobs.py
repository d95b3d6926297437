import datetime as dt

from jobloom.operators import keywords, queue, search, versions, wide
from jobloom.sources import tables as io
from jobloom.sources.folders import shared_dir


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stop_rules(spark):
    pages = spark.createDataFrame([(1, 1, 5, 3), (1, 2, 5, 3), (1, 3, 5, 3), (1, 4, 5, 3), (2, 1, 5, 9), (2, 2, 0, 1), (2, 3, 5, 9), (3, 1, 0, 1)], "keyword_id int, page_no int, n_cards int, max_page int")
    assert rows(search.kept_pages(pages), "keyword_id", "page_no") == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert rows(search.kept_pages(pages, use_max_page=False), "keyword_id", "page_no") == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    assert rows(search.last_max_page(pages, 2), "keyword_id", "max_page") == [(1, 3), (2, 9), (3, 2)]


def test_first_seen(spark):
    found = spark.createDataFrame([(1, 2, 0, "h/a"), (1, 1, 1, "http://h/a?x"), (1, 1, 0, "http://h/b"), (2, 1, 0, "http://h/a"), (1, 3, 0, "http://g/a#z")], "keyword_id int, page_no int, pos int, job_url string")
    once = search.first_seen(found)
    assert rows(once, "keyword_id", "job_url") == [(1, "h/a"), (1, "http://h/a?x"), (1, "http://h/b"), (2, "http://h/a")]
    assert rows(search.first_seen(once), "keyword_id", "job_url") == rows(once, "keyword_id", "job_url")


def test_frontier_and_results(spark):
    d = dt.datetime
    kw = spark.createDataFrame([(1, "a", "c", d(2024, 1, 2), None), (2, "b", "c", None, None), (3, "e", "c", d(2024, 1, 1), "success"), (4, "f", "c", None, None)], "id long, keyword string, category string, last_crawl timestamp_ntz, status string")
    assert [r.id for r in keywords.frontier(kw, 3).collect()] == [2, 4, 3]
    res = "id long, crawl_time timestamp_ntz"
    out = keywords.apply_results(kw, spark.createDataFrame([(1, d(2024, 2, 1)), (2, d(2024, 2, 1))], res), spark.createDataFrame([(1, d(2024, 1, 30)), (99, d(2024, 1, 1))], res))
    assert out.columns == kw.columns and rows(out.where("id < 3"), "id", "status", "last_crawl") == [(1, "error", d(2024, 1, 30)), (2, "success", d(2024, 2, 1))]
    assert keywords.page_requests(kw, 1, 2).count() == 8


def test_staggered(spark):
    out = keywords.staggered(spark.range(50).selectExpr("id", "concat('k ', id) keyword"), "2024-01-01 00:00:00").orderBy("id").collect()
    assert [r.number for r in out] == list(range(50)) and out[4].start_at == dt.datetime(2024, 1, 1, 1) and out[4].schedule_id == "crawl_keyword_4_k_4"


def test_far_schedule_numbers(spark):
    assert keywords.start_at(spark.range(200_000_000, 200_000_001).withColumnRenamed("id", "number"), "2024-01-01 00:00:00", 15).first().start_at == dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * 200_000_000)


def test_queue(spark):
    d = dt.datetime
    q = spark.createDataFrame([(f"https://example.com/job/{k}", str(k), s, n, e, t) for k, s, n, e, t in [
        (1, "pending", 0, None, d(2025, 11, 11, 10)), (2, "failed", 3, "Timeout error", d(2025, 11, 11, 11)), (3, "completed", 1, None, None), (4, "pending", 0, None, d(2025, 11, 12, 9)), (5, "failed", 2, "Connection refused", d(2025, 11, 12, 10, 30))]],
        "url string, hash_value string, status string, attempts int, last_error string, next_try_at timestamp_ntz")
    assert rows(queue.due(q, "2025-11-12 00:00:00"), "hash_value") == [("1",), ("2",)]
    links = spark.createDataFrame([("u", "9", 2), ("v", "9", 1), ("w", "1", 1), ("x", None, 1)], "url string, hash_value string, n int")
    new = queue.enqueue(q, links, "2025-11-12 00:00:00", "topcv", "n")
    assert rows(new, "url", "hash_value", "status", "attempts") == [("v", "9", "pending", 0)]
    assert queue.enqueue(q.select(*[c for c in q.columns]).unionByName(new.select(*q.columns)), links, "2025-11-12 00:00:00", "topcv", "n").count() == 0


def test_retries(spark):
    d = dt.datetime(2025, 1, 1)
    log = [("a", d, "e1", None), ("a", d + dt.timedelta(1), "e2", "30"), ("b", d, "x", "soon")] + [("c", d + dt.timedelta(k), "y", None) for k in range(5)]
    out = {r.url: r for r in queue.retries(spark.createDataFrame(log, "url string, ts timestamp_ntz, error string, retry_after string")).collect()}
    assert (out["a"].attempts, out["a"].next_try_at) == (2, d + dt.timedelta(days=1, seconds=30)) and out["b"].next_try_at == d + dt.timedelta(seconds=6)
    assert (out["c"].status, out["c"].next_try_at, out["c"].attempts) == ("given_up", None, 5) and out["b"].status == "failed"
    late = queue.retries(spark.createDataFrame(log, "url string, ts timestamp_ntz, error string, retry_after string"))
    assert rows(queue.due(late, "2035-01-01 00:00:00"), "url") == [("a",), ("b",)]  # what is given up is never due


def test_topics(spark):
    topics = spark.createDataFrame([(1, "pending"), (2, "done"), (3, "pending"), (4, "pending")], "id long, status string")
    taken, held = queue.claim(topics, 2)
    assert rows(taken, "id") == [(1,), (3,)] and rows(held, "id", "status") == [(1, "in_progress"), (2, "done"), (3, "in_progress"), (4, "pending")]
    back = queue.release(held, spark.createDataFrame([(1, True), (2, False)], "id long, success boolean"))
    assert rows(back, "id", "status") == [(1, "done"), (2, "failed"), (3, "in_progress"), (4, "pending")]
    e = [(1, 1, 1, "acquire", None), (1, 2, 2, "release", True), (1, 3, 3, "acquire", None), (2, 1, 4, "release", False), (2, 2, 5, "acquire", None), (3, 1, 6, "acquire", None)]
    st = queue.topic_states(spark.createDataFrame(e, "topic_id long, ts int, seq int, action string, success boolean"))
    assert rows(st, "topic_id", "status") == [(1, "done"), (2, "failed"), (3, "in_progress")] and st.where("acquired_at is null").count() == 1


def test_versions(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "url_hash string, seen_at int, v string")
    now, past = versions.split(r)
    assert rows(now, "url_hash", "v") == rows(versions.current(r), "url_hash", "v") == [("a", "y"), ("b", "w")]
    assert rows(now.unionByName(past), "url_hash", "seen_at", "v") == rows(r, "url_hash", "seen_at", "v")


def test_wide_keeps_every_card(spark):
    from jobloom.operators.extract import COMPANY_COLUMNS, DETAIL_COLUMNS, LINK_COLUMNS

    s = lambda cols: ", ".join(f"{c} string" for c in cols)
    cards = spark.createDataFrame([("t", "j1", None, "c1", None, None, None), ("t", "j2", None, None, None, None, None)], s(LINK_COLUMNS))
    details = spark.createDataFrame([("j1", *["d"] * 11, "")], s(["job_url", *DETAIL_COLUMNS]))
    firms = spark.createDataFrame([("c1", *["f"] * 6)], s(["company_url_eff", *COMPANY_COLUMNS]))
    out = wide.job_wide(cards, details, firms)
    assert out.columns == wide.WIDE_COLUMNS and len(out.columns) == 25 and rows(out, "job_url", "company_size") in ([("j1", "f"), ("j2", None)],)
    assert wide.job_wide(cards.limit(0), details, firms).count() == 0


def test_keyword_lists(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("\n  Kỹ sư \nData Engineer\nData Engineer\n", encoding="utf-8")
    (tmp_path / "x.csv").write_text("no\n")
    got = io.read_keyword_lists(spark, str(tmp_path))
    assert rows(got, "keyword", "category") == [("Data Engineer", "a b"), ("Data Engineer", "a b"), ("Kỹ sư", "a b")]
    assert io.read_keyword_lists(spark, str(tmp_path), distinct=True).count() == 2


def test_repeated_details_keep_one_row_a_card(spark):
    from jobloom.operators.extract import COMPANY_COLUMNS, DETAIL_COLUMNS, LINK_COLUMNS

    s = lambda cols: ", ".join(f"{c} string" for c in cols)
    cards = spark.createDataFrame([("t", "j1", None, "c1", None, None, None)], s(LINK_COLUMNS))
    details = spark.createDataFrame([("j1", f"d{k}", *["d"] * 10, "") for k in (2, 1)] + [(None, *["n"] * 12)], s(["job_url", *DETAIL_COLUMNS]))
    firms = spark.createDataFrame([("c1", *[f"f{k}"] * 6) for k in (4, 3)], s(["company_url_eff", *COMPANY_COLUMNS]))
    assert rows(wide.job_wide(cards, details, firms), "job_url", "detail_title", "company_size") == [("j1", "d1", "f3")]


def test_a_failed_page_never_blanks_a_good_one(spark):
    from jobloom.operators.extract import COMPANY_COLUMNS, DETAIL_COLUMNS, LINK_COLUMNS

    s = lambda cols: ", ".join(f"{c} string" for c in cols)
    cards = spark.createDataFrame([("t", "j1", None, "c1", None, None, None)], s(LINK_COLUMNS))
    d = lambda title, day: ("j1", title, *[None] * 10, None, day and dt.datetime(2024, 1, day))
    f = lambda size: ("c1", None, None, size, None, None, None)
    for order in (1, -1):
        for rows_, want in (([d("good", 1), d(None, 2)], "good"), ([d("new", 3), d("better", 2), d(None, 9)], "new"), ([d("dated", 1), d("a", None)], "dated"), ([d("b", 1), d("a", 1)], "a")):
            details = spark.createDataFrame(rows_[::order], s(["job_url", *DETAIL_COLUMNS]) + ", fetched_at timestamp_ntz")
            firms = spark.createDataFrame([f("50"), f(None)][::order], s(["company_url_eff", *COMPANY_COLUMNS]))
            assert rows(wide.job_wide(cards, details, firms), "detail_title", "company_size") == [(want, "50")]
            undated = wide.job_wide(cards, details.drop("fetched_at"), firms).first()
            assert undated.detail_title is not None


def test_relational_append(spark):
    """Derby, which comes with Spark, stands for the relational store."""
    from jobloom.operators.wide import WIDE_COLUMNS

    df = spark.createDataFrame([("t", None, *["x"] * 23)], ", ".join(f"{c} string" for c in WIDE_COLUMNS))
    url = "jdbc:derby:memory:jobs;create=true"
    opts = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    io.append_jobs(df, url, "jobs", opts)
    io.append_jobs(df, url, "jobs", opts)
    assert spark.read.format("jdbc").option("url", url).option("dbtable", "jobs").options(**opts).load().count() == 2


def test_versions_on_disk(spark):
    root = shared_dir(spark, "v")
    path = io.write_version(spark.range(3), root, 1)
    assert spark.read.parquet(path).count() == 3 and path.endswith("v=00000001") and io.preview(spark.range(9)).count() == 5
