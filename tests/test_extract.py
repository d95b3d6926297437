from jobloom.functions.html import Page, Selectors, with_parsed
from jobloom.operators import extract


def page(spark, html, **more):
    return spark.createDataFrame([(1, html)], "page_no int, html string")


def test_selectors():
    html = ("<div id=a class='x y'><p class=t>one<p>two<br>three</div><section><a href='/cong-ty/1'>L &amp; M</a></section><script><p>no</p></script>")
    text = lambda css: [n.text() for n in Selectors({"x": css})(html).all("x")]
    assert text("div#a.x p") == ["one", "two three"] and text("a[href*='/cong-ty/']") == ["L & M"] and text("a[href='/cong-ty/1'], p.t") == ["one", "L & M"]
    assert text("section p") == [] and Selectors({})(html).root.text() == "one two three L & M"


def test_search_page(spark):
    html = "<div class='job-item-search-result'><h3 class=title><a href='/v/1?x'>A&nbsp;  b</a></h3><a class=company href=c/2><b class=company-name>C</b></a><label class=exp><span>1</span></label></div><div class='job-item-search-result'><h3>no link</h3></div><span id=job-listing-paginate-text>1 / 7 trang</span>"
    parsed = extract.search_pages(page(spark, html))
    rows = extract.cards(parsed).collect()
    assert len(rows) == 1 and rows[0].max_page == 7
    assert (rows[0].title, rows[0].job_url, rows[0].company, rows[0].company_url, rows[0].salary_list, rows[0].exp_list) == ("A b", "https://www.topcv.vn/v/1?x", "C", "https://www.topcv.vn/c/2", None, "1")


def test_stretches_of_the_walk():
    page = Selectors({"box": "div.b", "p": "p", "both": "p, .b p"})("<div class=b><p>1<div class=b><p>2</div></div><p>3")
    outer, inner = page.all("box")
    text = lambda nodes: [n.text() for n in nodes]
    assert text(page.all("p")) == ["1", "2", "3"] == text(page.all("both")) and text(page.all("p", outer)) == ["1", "2"] and text(page.all("p", inner)) == ["2"]
    assert page.first("box", inner) is None and page.first("p", outer).text() == "1"


def test_a_page_that_fails_gives_nulls(spark):
    def read(page: Page) -> dict:
        return {"n": 1 // (len(page.all("p")) - 1)}

    rows = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>a</p><p>b</p>"), (3, None)], "k int, html string")
    assert [(r.k, r.parsed and r.parsed.n) for r in with_parsed(rows, Selectors({"p": "p"}), read, "n int").orderBy("k").collect()] == [(1, None), (2, 1), (3, None)]


def test_errors_can_be_told_from_empty_pages(spark):
    def read(page: Page) -> dict:
        return {"n": 1 // (len(page.all("p")) - 1)}

    rows = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, "<p>a</p><p>b</p>", "x"), (3, None, "x")], "k int, html string, failed string")
    got = with_parsed(rows, Selectors({"p": "p"}), read, "n int", error="failed").orderBy("k").collect()
    assert [(r.parsed and r.parsed.n, (r.failed or "").split(":")[0]) for r in got] == [(None, "ZeroDivisionError"), (1, ""), (None, "")]
    page = spark.createDataFrame([("u", "<h1>T</h1>")], "job_url string, html string")
    assert extract.job_details(page, error="failed").first().failed is None and extract.job_details(page).columns == ["job_url", *extract.DETAIL_COLUMNS]


def test_null_page_gives_nulls(spark):
    row = extract.job_details(spark.createDataFrame([("u", None)], "job_url string, html string")).first()
    assert row.job_url == "u" and set(row.asDict().values()) == {"u", None} and len(row) == 13
    assert set(extract.companies(spark.createDataFrame([("u", None)], "company_url_eff string, html string")).first().asDict().values()) == {"u", None}


def test_info_values(spark):
    s = "<div class=job-detail__info--section><i class=job-detail__info--section-content-title>{}</i>{}</div>"
    v = "<i class=job-detail__info--section-content-value>{}</i>"
    html = "<h1>T</h1>" + s.format("mức lương", v.format(" ")) + s.format("Mức lương", v.format("9")) + s.format("Địa điểm", "Hà <b>Nội</b>") + "<div class=job-detail__info--deadline>Hạn nộp 1/2/2025</div>"
    row = extract.job_details(spark.createDataFrame([("u", html)], "job_url string, html string")).first()
    assert (row.detail_title, row.detail_salary, row.detail_location, row.detail_experience, row.deadline) == ("T", None, "Địa điểm Hà Nội", None, "1/2/2025")


def test_company_last_match_and_names(spark):
    html = "<title>N | TopCV x</title><h1 class=company-name> </h1><meta property='og:title' content=' raw '><ul><li>Website: a</li><li><b>WEBSITE</b> b - website</li><li>Address：Số 1</li></ul><div class=description></div><div id=readmore-content>D</div>"
    row = extract.companies(spark.createDataFrame([("u", html)], "company_url_eff string, html string")).first()
    assert (row.company_name_full, row.company_website, row.company_address, row.company_description, row.company_size) == (" raw ", "b", "Số 1", "D", None)


def test_a_crawl_parses_each_page_once(spark):
    from jobloom.operators import extract, search

    html = '<div class="job-item-search-result"><h3 class="title"><a href="/viec-lam/{}.html">t</a></h3></div>'
    pages = spark.createDataFrame([(1, n, html.format(n) if n < 3 else "<p>none</p>") for n in range(1, 5)] + [(2, 1, None)], "keyword_id long, page_no long, html string")
    found = search.search_links(extract.search_pages(pages), use_max_page=False)
    assert sorted((r.keyword_id, r.page_no, r.pos, r.job_url) for r in found.collect()) == [(1, n, 0, f"https://www.topcv.vn/viec-lam/{n}.html") for n in (1, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_tags_read_before_are_read_alike():
    from jobloom.functions import html as h

    page = '<!DOCTYPE html><p a="1">x<div class="a &amp; b">1</div><DIV class="a &amp; b">2</DIV ><br/><br/><script>"<p a=1>"</script><title>a<b</title><p a="1">y</p><script>z</script><a b c="1" c="2">t</a>' * 2
    tree = lambda: [(n.tag, n.attrs, n.place, n.last, [x if isinstance(x, str) else x.place for x in n.parts]) for n in h.parse(page)]
    h.TAGS.clear()
    first, known = tree(), dict(h.TAGS)
    assert tree() == first and '<p a="1">' in known and not any(t.startswith("<script") for t in known)
    assert [n[4] for n in first if n[0] == "script"] == [['"<p a=1>"'], ["z"]] * 2 and sum(n[0] == "p" for n in first) == 4
