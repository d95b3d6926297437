import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from jobloom.functions import text as t
from jobloom.functions.urls import resolve, search_url, url_hash, url_key, url_path


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


# Keywords and the slugs that they must give.
SLUGS = {
    "Kỹ sư phần mềm": "ky-su-phan-mem", "Quản trị mạng": "quan-tri-mang", "Phát triển web": "phat-trien-web", "Lập trình viên Java": "lap-trinh-vien-java",
    "Chuyên viên phân tích dữ liệu": "chuyen-vien-phan-tich-du-lieu", "Kinh doanh thiết bị/vật liệu xây dựng": "kinh-doanh-thiet-bi-vat-lieu-xay-dung",
    ".NET": "-net", "Software Tester (Automation & Manual)": "software-tester--automation---manual-", "Đà Nẵng": "da-nang", "Straße": "strasse", "a \t\n b": "a-b", "é": "e", "": "",
}


def test_slug(spark):
    assert values(spark, [*SLUGS, None], t.slug("v")) == [*SLUGS.values(), None]


def test_clean(spark):
    assert values(spark, ["  a    b\n", " \t", "", None], t.clean("v")) == ["a b", None, None, None]


def test_url_keys(spark):
    job = "https://www.topcv.vn/viec-lam/data-analyst-hr/1933814.html?ta_source=x"
    assert values(spark, [job, "a/853/", "x", "", None, "h/a/b#f?q"], url_key("v")) == ["data-analyst-hr/1933814.html", "853/", "x", "", None, "a/b#f"]
    long = "https://www.topcv.vn/viec-lam/nhan-vien-kinh-doanh-tu-van-ban-hang-cham-soc-khach-hang-luong-upto-25-trieu/1904152.html?x=1"
    assert values(spark, [long, job, "", None], url_hash("v")) == ["ae6a8ffb65a3bd4c3b19d1d67527e27247c01ea9063960ed37ed2a0c2f105e82", "f5d73dd7db47fa7e68f91b990754cd38dc05125a6eaaf8318b0630ba7f22487e", None, None]
    assert values(spark, ["http://h/a/b.html?x=1#f", "http://h", "/a?b", "", None], url_path("v")) == ["/a/b.html", "", "/a", "", None]


def test_resolve(spark):
    cases = {"//h/x": "https://h/x", "/a": "https://www.topcv.vn/a", "a": "https://www.topcv.vn/a", "?q": "https://www.topcv.vn?q", "#f": "https://www.topcv.vn#f", "": "https://www.topcv.vn", "mailto:x": "mailto:x", "../z": "https://www.topcv.vn/z", "http://o/p": "http://o/p"}
    assert values(spark, [*cases, None], resolve("v")) == [*cases.values(), None]


def test_search_url(spark):
    assert values(spark, ["java"], search_url("v", F.lit(2))) == ["https://www.topcv.vn/tim-viec-lam-java?type_keyword=1&page=2&sba=1"]


def test_max_page(spark):
    assert values(spark, ["5 / 5 trang", "1 / 5 trang", "no", None, "1 /12trang", "1 / 99999999999999 trang"], t.max_page("v")) == [5, 5, 1, 1, 12, 1]


def test_deadline(spark):
    rows = [["x", "Hạn nộp: 5/12/2025"], ["Hạn nộp sớm", "Hạn nộp 1/1/2024"], ["1/1/2020"], [], None]
    assert values(spark, [(r,) for r in rows], t.deadline("v"), "v array<string>") == ["5/12/2025", "Hạn nộp sớm", None, None, None]


def test_brand_and_labels(spark):
    assert values(spark, ["ABC | topcv tuyển", "X", "| TopCV", None], t.without_brand("v")) == ["ABC", "X", "", None]
    rows = [("Quy mô: 100 nhân viên - QUY MÔ", "quy mô"), ("a.b", "."), ("x\\E1", "\\E"), (None, "a")]
    assert values(spark, rows, t.without_label("v", "l"), "v string, l string") == ["100 nhân viên", "ab", "x1", None]
    assert values(spark, ["Địa chỉ： Hà Nội", "a:", ":b", "a: b: c", None], F.concat_ws("|", t.label_part("v"), t.value_part("v"))) == ["Địa chỉ|Hà Nội", "", "", "a|b: c", ""]
    labels = ["Website", "Trang Web", "Quy  mô", "Nhân sự", "Company size website", "Ngành", "Industry", "Địa chỉ", "Address", "Tel", None]
    assert values(spark, labels, t.company_field("v")) == ["website", "website", "size", "size", "website", "industry", "industry", "address", "address", None, None]


def test_lists(spark):
    assert values(spark, [(["a", "b"],), ([],), (None,)], t.joined("v"), "v array<string>") == ["a; b", None, None]
    blocks = [[("k", "1"), ("k", "2"), ("x", "3")], [], None]
    assert values(spark, [(b,) for b in blocks], t.last_text("v", "k"), "v array<struct<title: string, text: string>>") == ["2", None, None]


def test_labels_of_time(spark):
    ts = F.expr("TIMESTAMP_NTZ '2025-11-11 10:02:03'")
    assert values(spark, ["java"], t.output_label("v", F.lit(1), F.lit(2), F.lit(5), ts)) == ["java-1_to_2-20251111100203"]
    assert values(spark, ["Nhan vien A/B"], t.schedule_id(F.lit(3), "v")) == ["crawl_keyword_3_nhan_vien_a_b"]
    assert values(spark, ["x"], t.state_time(ts)) == ["2025-11-11 10:02:03"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_slug_and_key_properties(spark, texts):
    texts = [x.replace("\x00", "").encode("utf-8", "ignore").decode() for x in texts]
    slugs = values(spark, texts, t.slug("v"))
    assert all(re.fullmatch("[a-z0-9-]*", s) for s in slugs)
    assert values(spark, slugs, t.slug("v")) == slugs
    assert values(spark, [x.split("?")[0] + "?q=1" for x in texts], url_key("v")) == values(spark, [x.split("?")[0] for x in texts], url_key("v"))


@pytest.mark.parametrize("text, ok", [("a b", True)])
def test_clean_ends(spark, text, ok):
    assert values(spark, [f"  {text}\t"], t.clean_ends("v")) == [text]
