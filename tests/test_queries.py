"""Every query of the library against its SQL on DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from jobloom.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows):
    return Counter(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert cells(df.select(*order).collect()) == cells(want.select(", ".join(order)).fetchall())


def test_titles_and_links_with_odd_entities(spark, tmp_path):
    heads = ["<title>A&amp;&amp;&amp</title>", "<title>A &lt b &eacute; &#39;x&#x27; &amp;lt; | topcv y</title>", "<title> </title><h1>H</h1>", "<h1>H</h1>", "<title>a\n b", "<title>\u00a0B&amp;amp;\n|  TOPCV</title><title>2</title>", None]
    nav = '<nav><ul><li><a href="/a?x&amp;y&ampz">T &amp</a></li><li><a href="/b">&copy; &quot;u&quot;</a></li></ul></nav>'
    rows = [(k, "u", None if h is None else f"<!DOCTYPE html><html><head>{h}</head><body>{nav if '</title>' in h else ''}<article>x</article></body></html>") for k, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_title", "nav_links"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE[name])
        order = sorted(got.columns)
        assert cells(got.select(*order).collect()) == cells(want.select(", ".join(order)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(ORACLE) <= set(__spark_entry__.oracle_sql())
