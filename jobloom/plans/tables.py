"""Queries over tables: expressions, joins, windows, queue and versions; each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as t
from ..functions.urls import BASE, url_hash, url_key, url_path
from ..operators import extract, keywords, queue, search, versions, wide

NOW = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts and URLs.


def keyword_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = t.slug("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(slug).cast("long").alias("slug_length"), F.sha2(slug, 256).alias("slug_sha256"))


_PAIRED = f"translate(lower(text), '{t.FROM}', '{t.TO}')"
for _a, _b in t.PAIRS.items():
    _PAIRED = f"replace({_PAIRED}, '{_a}', '{_b}')"
SLUG_SQL = rf"regexp_replace(regexp_replace(regexp_replace({_PAIRED}, '\p{{M}}', '', 'g'), '{t.WHITE}', '-', 'g'), '[^a-z0-9-]', '-', 'g')"


def clean_sql(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '{t.WHITE}', ' ', 'g'), ' '), '')"


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.clean("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("clean_length"), F.sha2(c, 256).alias("clean_sha256"))


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_key("url").alias("url_key"), url_hash("url").alias("url_hash"), url_path("url").alias("url_path"))


KEY_SQL = "array_to_string(list_slice(string_split(split_part(url, '?', 1), '/'), -2, -1), '/')"
HASH_SQL = f"CASE WHEN url <> '' THEN sha256({KEY_SQL}) END"
PATH_SQL = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)', 1)"


def query_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword")).distinct()
    return keywords.page_requests(words, 1, 3).select("keyword", "slug", F.col("page_no").cast("long").alias("page_no"), "url")


# Keywords.


def _crawl_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keywords; the last order before 1996 as the last crawl."""
    last = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_crawl"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("keyword"), F.col("c_mktsegment").alias("category"))
    return c.join(last, c.id == last.o_custkey, "left").select("id", "keyword", "category", "last_crawl", F.when(F.col("last_crawl").isNotNull(), "success").alias("status"))


KEYWORDS_SQL = """kw AS (SELECT c_custkey AS id, c_name AS keyword, c_mktsegment AS category, l.last_crawl, CASE WHEN l.last_crawl IS NOT NULL THEN 'success' END AS status
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_crawl FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) l ON c_custkey = l.o_custkey)"""


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.frontier(_crawl_keywords(spark, sf_dir), 100)


def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("crawl_time"), "event_type")
    return keywords.apply_results(_crawl_keywords(spark, sf_dir), e.where("event_type = 'purchase'"), e.where("event_type = 'error'"))


STATUS_SQL = f"""WITH {KEYWORDS_SQL}, r AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS st,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 1 ELSE 0 END DESC, ts DESC) AS n FROM events WHERE event_type IN ('purchase', 'error'))
SELECT id, keyword, category, coalesce(ts, last_crawl) AS last_crawl, coalesce(st, status) AS status FROM kw LEFT JOIN r ON id = user_id AND n = 1"""


def stagger_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("keyword"))
    out = keywords.staggered(parts, "2024-01-01 08:00:00")
    return out.select("id", "number", "schedule_id", "start_at", t.state_time("start_at").alias("start_text"), t.file_time("start_at").alias("start_name"))


STAGGER_SQL = """WITH p AS (SELECT p_partkey AS id, p_name AS keyword, row_number() OVER (ORDER BY p_partkey) - 1 AS number FROM part),
s AS (SELECT *, TIMESTAMP '2024-01-01 08:00:00' + to_minutes(CAST(15 * number AS BIGINT)) AS start_at FROM p)
SELECT id, number, lower('crawl_keyword_' || number || '_' || translate(keyword, ' /', '__')) AS schedule_id, start_at,
  strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_text, strftime(start_at, '%Y%m%d%H%M%S') AS start_name FROM s"""


# Search crawls.


def first_seen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))
    return search.first_seen(p, "host", ("page_id",), "url").select("host", "page_id", url_path("url").alias("url_path"))


FIRST_SEEN_SQL = rf"""SELECT host, page_id, url_path FROM (SELECT *, row_number() OVER (PARTITION BY host, url_path ORDER BY page_id) AS n
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {PATH_SQL} AS url_path FROM pages)) WHERE n = 1"""


def page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user by day as the pages of a keyword: the days before the first empty one."""
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("keyword_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("page_no"))
    own = days.groupBy("keyword_id", "page_no").agg(F.count(F.lit(1)).alias("n_cards"))
    grid = days.groupBy("keyword_id").agg(F.max("page_no").alias("m")).select("keyword_id", F.explode(F.expr("sequence(0, m)")).alias("page_no"))
    pages = grid.join(own, ["keyword_id", "page_no"], "left").select("keyword_id", "page_no", F.coalesce("n_cards", F.lit(0)).alias("n_cards"))
    return search.kept_pages(pages, use_max_page=False).select("keyword_id", F.col("page_no").cast("long").alias("page_no"), "n_cards")


PAGE_STOP_SQL = """WITH d AS (SELECT user_id AS keyword_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS page_no FROM events),
g AS (SELECT keyword_id, unnest(generate_series(0, max(page_no))) AS page_no FROM d GROUP BY keyword_id),
p AS (SELECT g.keyword_id, g.page_no, count(d.keyword_id) AS n_cards FROM g LEFT JOIN d USING (keyword_id, page_no) GROUP BY 1, 2)
SELECT keyword_id, page_no, n_cards FROM (SELECT *, max(CASE WHEN n_cards = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY keyword_id ORDER BY page_no) AS stop FROM p) WHERE stop = 0"""


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as result pages: numbered by key, the paginator text from the price."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("page_no", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    paginator = F.concat(F.col("page_no").cast("string"), F.lit(" / "), (F.floor("o_totalprice") % 23 + 1).cast("string"), F.lit(" trang"))
    text = F.when(F.col("o_orderkey") % 19 == 0, F.lit(None)).otherwise(paginator)
    return o.select(F.col("o_custkey").alias("keyword_id"), "page_no", (F.col("o_orderkey") % 11).alias("n_cards"), t.max_page(text).alias("max_page"))


def max_page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _order_pages(spark, sf_dir)
    last = search.last_max_page(pages, 40).withColumnRenamed("max_page", "last_page")
    kept = search.kept_pages(pages).join(last, "keyword_id")
    label = t.output_label(F.concat(F.lit("kw-"), F.col("keyword_id").cast("string")), F.lit(1), F.lit(40), "last_page", F.expr("TIMESTAMP_NTZ '2024-01-01 10:20:30'"))
    return kept.select("keyword_id", F.col("page_no").cast("long").alias("page_no"), F.col("max_page").cast("long").alias("max_page"), F.col("last_page").cast("long").alias("last_page"), label.alias("label"))


MAX_PAGE_SQL = """WITH p AS (SELECT o_custkey AS keyword_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey % 11 AS n_cards,
  CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE CAST(floor(o_totalprice) AS BIGINT) % 23 + 1 END AS max_page FROM orders),
s AS (SELECT *, max(CASE WHEN n_cards = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY keyword_id ORDER BY page_no) AS e,
  coalesce(max(CASE WHEN page_no >= max_page THEN 1 ELSE 0 END) OVER (PARTITION BY keyword_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM p),
k AS (SELECT keyword_id, page_no, max_page FROM s WHERE e = 0 AND r = 0), l AS (SELECT keyword_id, arg_max(max_page, page_no) AS last_page FROM k GROUP BY 1)
SELECT keyword_id, page_no, max_page, last_page, 'kw-' || keyword_id || '-1_to_' || least(40, last_page) || '-20240101102030' AS label FROM k JOIN l USING (keyword_id)"""


# The wide table.


def job_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cards, orders as job pages (some fetched twice, or failed the last time), suppliers as companies."""
    s = lambda e: F.expr(f"cast({e} as string)")
    li = table(spark, sf_dir, "lineitem")
    found = li.select(
        s("concat('line ', l_linenumber)").alias("title"), s(f"concat('{BASE}/viec-lam/', l_orderkey, '.html')").alias("job_url"), s("concat('Supplier ', l_suppkey)").alias("company"),
        F.when(F.col("l_partkey") % 7 > 0, s(f"concat('{BASE}/cong-ty/', l_suppkey)")).alias("company_url"), s("l_returnflag").alias("salary_list"), s("l_linestatus").alias("address_list"), s("l_partkey").alias("exp_list"))
    own = {"detail_title": "concat('Order ', o_orderkey)", "detail_salary": "o_orderpriority", "detail_location": "o_orderstatus", "desc_mota": "concat('task ', o_custkey)",
           "company_url_from_job": f"case o_custkey % 3 when 0 then concat('{BASE}/cong-ty/', o_custkey % 100) when 1 then '' end"}
    o = table(spark, sf_dir, "orders").withColumn("fetch", F.explode(F.array(*map(F.lit, ("good", "failed", "old")))))
    o = o.where("(fetch = 'good' and o_orderkey % 5 <> 0) or (fetch = 'failed' and o_orderkey % 4 = 0) or (fetch = 'old' and o_orderkey % 3 = 0)")
    own["detail_title"] = "concat(if(fetch = 'old', 'Old order ', 'Order '), o_orderkey)"
    fields = [(F.when(F.col("fetch") != "failed", s(own[c])) if c in own else F.lit(None).cast("string")).alias(c) for c in extract.DETAIL_COLUMNS]
    fetched = F.when(F.col("fetch") == "old", F.col("o_orderdate")).otherwise(F.expr("timestampadd(DAY, if(fetch = 'failed', 2, 1), o_orderdate)"))
    details = o.select(s(f"concat('{BASE}/viec-lam/', o_orderkey, '.html')").alias("job_url"), *fields, fetched.alias("fetched_at"))
    named = {"company_name_full": "s_name", "company_size": "s_nationkey"}
    firms = table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0").select(s(f"concat('{BASE}/cong-ty/', s_suppkey)").alias("company_url_eff"), *[(s(named[c]) if c in named else F.lit(None).cast("string")).alias(c) for c in extract.COMPANY_COLUMNS])
    return wide.job_wide(found, details, firms)


_GIVEN = {"title": "'line ' || l_linenumber", "job_url": f"'{BASE}/viec-lam/' || l_orderkey || '.html'", "company": "'Supplier ' || l_suppkey", "company_url": "cu", "salary_list": "l_returnflag", "address_list": "l_linestatus", "exp_list": "CAST(l_partkey AS VARCHAR)",
          "detail_title": "dt", "detail_salary": "o_orderpriority", "detail_location": "o_orderstatus", "desc_mota": "'task ' || o_custkey", "company_url_from_job": "cj", "company_name_full": "s_name", "company_size": "CAST(s_nationkey AS VARCHAR)"}
WIDE_SQL = f"""WITH g AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN '{BASE}/cong-ty/' || (o_custkey % 100) WHEN 1 THEN '' END AS cj, 'Order ' || o_orderkey AS dt FROM orders),
f AS (SELECT o_orderkey AS k, dt, o_orderpriority, o_orderstatus, o_custkey, cj, 0 AS failed, 1 AS age FROM g WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, 1, 0 FROM g WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 'Old order ' || o_orderkey, o_orderpriority, o_orderstatus, o_custkey, cj, 0, 2 FROM g WHERE o_orderkey % 3 = 0),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY failed, age) = 1),
l AS (SELECT *, CASE WHEN l_partkey % 7 > 0 THEN '{BASE}/cong-ty/' || l_suppkey END AS cu FROM lineitem),
c AS (SELECT *, '{BASE}/cong-ty/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT {', '.join(f"{_GIVEN.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in wide.WIDE_COLUMNS)}
FROM l LEFT JOIN d ON l_orderkey = k LEFT JOIN c ON c.url = coalesce(nullif(cj, ''), nullif(cu, ''))"""


def jobs_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.relational(_wide(spark, sf_dir))


JOBS_SQL = f"""SELECT coalesce(detail_title, title) AS title, coalesce(company_name_full, company) AS company, coalesce(detail_location, address_list) AS location,
  desc_mota AS description, CAST(NULL AS DATE) AS posted_date FROM ({WIDE_SQL})"""


# The queue.


def _links(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    return table(spark, sf_dir, "pages").where(f"page_id % 2 = {odd}").select("page_id", "url", url_hash("url").alias("hash_value"))


def enqueue_new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = queue.distinct_links(_links(spark, sf_dir, 0), "page_id")
    return queue.enqueue(old, _links(spark, sf_dir, 1), NOW, "topcv", "page_id")


ENQUEUE_SQL = f"""WITH p AS (SELECT page_id, url, {HASH_SQL} AS hash_value FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY hash_value ORDER BY page_id) AS k FROM p WHERE page_id % 2 = 1 AND hash_value IS NOT NULL)
SELECT url, hash_value, 'pending' AS status, 0 AS attempts, CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS TIMESTAMP) AS next_try_at,
  TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at, 'topcv' AS source
FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE page_id % 2 = 0 AND p.hash_value = n.hash_value)"""


def new_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", url_hash("url").alias("url_hash"))
    now, past = p.where("page_id % 3 = 0"), p.where("page_id % 3 = 1")
    return queue.unknown(p.where("page_id % 3 = 2"), now, past, key="url_hash")


NEW_SQL = f"""WITH p AS (SELECT page_id, url, {HASH_SQL} AS url_hash FROM pages)
SELECT * FROM p WHERE page_id % 3 = 2 AND url_hash NOT IN (SELECT url_hash FROM p WHERE page_id % 3 < 2)"""


def _fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events of a user as failed tries of four URLs; every seventh names its own wait."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    wait = F.when(F.col("event_id") % 7 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 7 == 1, F.lit("soon"))
    return e.select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("url"), "ts", "event_id", F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"), wait.alias("retry_after"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = queue.retries(_fetch_log(spark, sf_dir), "url", "ts", "event_id")
    return out.select("url", F.col("attempts").cast("long").alias("attempts"), "last_error", "next_try_at", "status")


_RETRY = """r AS (SELECT user_id * 4 + event_id % 4 AS url, ts, event_id, row_number() OVER w AS attempts, lead(event_id) OVER w AS later FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id)),
q AS (SELECT url, attempts, 'error ' || event_id AS last_error,
  CASE WHEN attempts < 5 THEN ts + to_seconds(CASE WHEN event_id % 7 = 0 THEN event_id % 90 ELSE 6 * attempts END) END AS next_try_at, CASE WHEN attempts >= 5 THEN 'given_up' ELSE 'failed' END AS status FROM r WHERE later IS NULL)"""


RETRY_SQL = f"WITH {_RETRY} SELECT * FROM q"


def due_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue.retries(_fetch_log(spark, sf_dir), "url", "ts", "event_id")
    return queue.due(rows, NOW).select("url", F.col("attempts").cast("long").alias("attempts"), "status", "next_try_at")


def topic_events(e: DataFrame) -> DataFrame:
    """Events as topic events: signup and click acquire, purchase and error release; views don't count."""
    kind = F.when(F.col("event_type").isin("signup", "click"), "acquire").when(F.col("event_type").isin("purchase", "error"), "release")
    return e.select(F.col("user_id").alias("topic_id"), "ts", F.col("event_id").alias("seq"), kind.alias("action"), (F.col("event_type") == "purchase").alias("success")).where("action is not null")


def topic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.topic_states(topic_events(table(spark, sf_dir, "events")))


TOPIC_SQL = """WITH e AS (SELECT user_id AS topic_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'view'),
f AS (SELECT topic_id, min(n) FILTER (event_type IN ('signup', 'click')) AS a, min(ts) FILTER (event_type IN ('signup', 'click')) AS acq, min(n) FILTER (event_type IN ('purchase', 'error')) AS r,
  arg_max(event_type, n) FILTER (event_type IN ('purchase', 'error')) AS last FROM e GROUP BY 1)
SELECT topic_id, CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE CASE WHEN a IS NULL THEN 'pending' ELSE 'in_progress' END END AS status,
  CASE WHEN a IS NOT NULL AND (r IS NULL OR a < r) THEN acq END AS acquired_at FROM f"""


def _records(e: DataFrame) -> DataFrame:
    return e.select(F.sha2(F.col("user_id").cast("string"), 256).alias("url_hash"), F.col("ts").alias("seen_at"), "event_id", "event_type", "value")


def current_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current(_records(table(spark, sf_dir, "events")), "url_hash", "seen_at", "event_id")


def history_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.split(_records(table(spark, sf_dir, "events")), "url_hash", "seen_at", "event_id")[1]


VERSION_SQL = """SELECT url_hash, seen_at, event_id, event_type, value FROM (SELECT sha256(CAST(user_id AS VARCHAR)) AS url_hash, ts AS seen_at, event_id, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n {}"""


# Conversations as sections of a page.


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("blocks"))
    return c.select("conv_id", t.last_text("blocks", "user").alias("user_text"), t.last_text("blocks", "assistant").alias("assistant_text"), t.last_text("blocks", "tool").alias("tool_text"))


def tag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rows"))
    tags = F.transform(F.filter("rows", lambda r: r["turn"] > 0), lambda r: r["role"])
    return c.select("conv_id", t.joined(tags).alias("tags"))


QUERIES = {
    "keyword_slug": keyword_slug, "clean_text": clean_text, "url_keys": url_keys, "query_urls": query_urls, "frontier": frontier, "status_update": status_update, "stagger_schedule": stagger_schedule,
    "first_seen_links": first_seen_links, "page_stop": page_stop, "max_page_stop": max_page_stop, "job_wide": job_wide, "jobs_projection": jobs_projection, "enqueue_new_links": enqueue_new_links,
    "new_vs_history": new_vs_history, "due_links": due_links, "retry_schedule": retry_schedule, "topic_state": topic_state, "current_jobs": current_jobs, "history_jobs": history_jobs,
    "section_lookup": section_lookup, "tag_join": tag_join,
}

ORACLE = {
    "keyword_slug": f"SELECT doc_id, length(s) AS slug_length, sha256(s) AS slug_sha256 FROM (SELECT doc_id, {SLUG_SQL} AS s FROM documents)",
    "clean_text": f"SELECT doc_id, length(c) AS clean_length, sha256(c) AS clean_sha256 FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents)",
    "url_keys": f"SELECT page_id, {KEY_SQL} AS url_key, {HASH_SQL} AS url_hash, {PATH_SQL} AS url_path FROM pages",
    "query_urls": f"SELECT keyword, slug, page_no, '{BASE}/tim-viec-lam-' || slug || '?type_keyword=1&page=' || page_no || '&sba=1' AS url FROM (SELECT DISTINCT p_name AS keyword, {SLUG_SQL.replace('lower(text)', 'lower(p_name)')} AS slug FROM part), (SELECT unnest(generate_series(1, 3)) AS page_no)",
    "frontier": f"WITH {KEYWORDS_SQL} SELECT id, keyword, category FROM kw ORDER BY last_crawl ASC NULLS FIRST, id LIMIT 100",
    "status_update": STATUS_SQL, "stagger_schedule": STAGGER_SQL, "first_seen_links": FIRST_SEEN_SQL, "page_stop": PAGE_STOP_SQL, "max_page_stop": MAX_PAGE_SQL, "job_wide": WIDE_SQL, "jobs_projection": JOBS_SQL,
    "enqueue_new_links": ENQUEUE_SQL, "new_vs_history": NEW_SQL, "retry_schedule": RETRY_SQL,
    "due_links": f"WITH {_RETRY} SELECT url, attempts, status, next_try_at FROM q WHERE attempts < 5 AND next_try_at <= TIMESTAMP '{NOW}'",
    "topic_state": TOPIC_SQL, "current_jobs": VERSION_SQL.format("= 1"), "history_jobs": VERSION_SQL.format("> 1"),
    "section_lookup": "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS user_text, arg_max(text, turn) FILTER (role = 'assistant') AS assistant_text, arg_max(text, turn) FILTER (role = 'tool') AS tool_text FROM conversations GROUP BY 1",
    "tag_join": "SELECT conv_id, string_agg(role, '; ' ORDER BY turn, role) FILTER (turn > 0) AS tags FROM conversations GROUP BY 1",
}
