import base64
import gzip
import hashlib
import os

from jobloom.llm.warc import member, op7, read_archives, record, with_first, write_archives
from jobloom.llm.words import shared_dir

PAGES = [(1, "http://a/x y\r\nz", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (5, "u", "q" * 3_000_000), (6, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 no"), (6, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 no"), (None, "n", "<p>é</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, refers_to string, payload string")


def test_member_ends_in_zero():
    big = os.urandom(17 << 20)
    for data in (b"", b"abc", big):
        assert member(data)[-1] == 0 and gzip.decompress(member(data)) == data
    assert b"Content-Length: 0\r\n" in record(1, "u", b"abc", 7)


def test_round_trip(spark):
    first = {}
    for i, _, h in sorted(PAGES, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in PAGES:
        h = h or ""
        to = None if first[h] == i else first[h]
        want.append((str(i), len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if to is None else "revisit", str(to)))
    path = shared_dir(spark, "warc")
    write_archives(pages(spark), path)
    for split in (1000, 8 << 20):
        got = read_archives(spark, path, split).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
        assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.payload is not None} == {(i, h or "") for i, _, h in PAGES if str(i) in {w[0] for w in want if w[3] == "response"}}


def test_small_payloads_are_all_responses(spark):
    assert with_first(pages(spark), 100).where("refers_to is not null").count() == 0
    assert with_first(pages(spark), 5).where("refers_to is not null").count() == 2


def test_empty_and_damaged(spark, tmp_path):
    path = shared_dir(spark, "warc")
    write_archives(pages(spark).limit(0), path)
    assert read_archives(spark, path).count() == 0
    good, other = member(record(1, "u", b"one", None)), member(record(2, "u", b"two", None))
    (tmp_path / "a.warc.gz").write_bytes(good[:-30] + b"junk\x1f\x8b\x08junk" + other + b"\x1f\x8b\x08" + good)
    assert sorted(r.page_id for r in read_archives(spark, f"file://{tmp_path}", 50).collect()) == [1, 2]


def test_query(spark, sf_dir):
    assert op7(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_ranges_are_read_by_many_tasks(spark):
    path = shared_dir(spark, "warc")
    write_archives(spark.range(0, 400, 1, 4).selectExpr("id page_id", "concat('u', id) url", "repeat(md5(string(id)), 20) html"), path)
    got = read_archives(spark, path, 8000)
    sizes = [len(p) for p in got.select("page_id").rdd.glom().collect()]
    assert sum(sizes) == 400 and sum(n > 0 for n in sizes) > 5 and got.select("page_id").distinct().count() == 400
