"""Landed pages to records: search cards, job details, companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from ..functions.html import Node, Page, Selectors, with_parsed
from ..functions.urls import BASE, resolve

# The selectors of each kind of page.
CARD = "div.job-item-search-result"
CARD_FIELDS = {
    "title": ("h3.title a[href]", None), "href": ("h3.title a[href]", "href"), "company": ("a.company .company-name", None), "company_href": ("a.company[href]", "href"),
    "salary_list": ("label.title-salary", None), "address_list": ("label.address .city-text", None), "exp_list": ("label.exp span", None),
}
PAGINATOR = "span#job-listing-paginate-text"
JOB = {
    "title": ".job-detail__info--title, h1", "section": ".job-detail__info--section", "section_title": ".job-detail__info--section-content-title",
    "section_value": ".job-detail__info--section-content-value", "deadline": ".job-detail__info--deadline, .job-detail__information-detail--actions-label",
    "tag": ".job-tags a.item", "block": ".job-description .job-description__item", "block_title": "h3", "block_content": ".job-description__item--content",
    "heading": ".job-description__item h3", "places": ".job-description__item--content div, .job-description__item--content li",
    "company": "a.company[href]", "company_else": "a[href*='/cong-ty/']",
}
ITEM_CLASS = "job-description__item"
NAMES = ["h1.company-name", "h1.title", "div.company-header h1", "div.company-info h1", "meta[property='og:title']", "meta[property='og:site_name']", "title"]
BOXES = ["div.company-overview", "div.company-detail", "div.company-profile", "section#company", "section.company-info", "div.box-intro-company", "div.company-info-container"]
BOLD = "strong, b"
ROWS = "li, .row, .item, .info-item, .company-info-item, .dl, .d-flex"
ABOUT = ["div.company-description", "div#company-description", "div.box-intro-company", "div.company-introduction", "div.description", "section.company-description", "div#readmore-company", "div#readmore-content"]
# Titles of sections.
SALARY, LOCATION, EXPERIENCE = "Mức lương", "Địa điểm", "Kinh nghiệm"
TASKS, NEEDS, BENEFITS, PLACES, TIMES = "Mô tả công việc", "Yêu cầu ứng viên", "Quyền lợi", "Địa điểm làm việc", "Thời gian làm việc"

# The columns of each kind of record.
LINK_COLUMNS = ["title", "job_url", "company", "company_url", "salary_list", "address_list", "exp_list"]
DETAIL_COLUMNS = ["detail_title", "detail_salary", "detail_location", "detail_experience", "deadline", "tags", "desc_mota", "desc_yeucau", "desc_quyenloi", "working_addresses", "working_times", "company_url_from_job"]
COMPANY_COLUMNS = ["company_name_full", "company_website", "company_size", "company_industry", "company_address", "company_description"]


def nodes(pages: DataFrame, card: str, fields: dict[str, tuple[str, str | None]], extra: dict[str, str] | None = None, html: str = "html") -> DataFrame:
    """Each page's `cards` (an array of structs, one for each node `card`) and the text of the first node of each `extra`.

    fields: name -> (selector within the card, attribute or None for its text).
    """
    chosen = Selectors({"card": card} | {f"in {k}": css for k, (css, _) in fields.items()} | (extra or {}))

    def value(node: Node | None, attr: str | None) -> str | None:
        return None if node is None else node.text() if attr is None else node.attrs.get(attr)

    def read(page: Page) -> dict:
        return {"cards": [{k: value(page.first(f"in {k}", c), attr) for k, (_, attr) in fields.items()} for c in page.all("card")]} | {k: value(page.first(k), None) for k in extra or {}}

    schema = f"cards array<struct<{', '.join(f'{k}: string' for k in fields)}>>" + "".join(f", {k} string" for k in extra or {})
    out = with_parsed(pages, chosen, read, schema, html)
    return out.select(*[c for c in out.columns if c != "parsed"], "parsed.*")


def search_pages(pages: DataFrame, base: str = BASE) -> DataFrame:
    """Search pages without html, with `max_page` and `cards` (array of the seven fields; cards without a title link go)."""
    found = nodes(pages, CARD, CARD_FIELDS, {"paginator": PAGINATOR})
    card = lambda c: F.struct(
        *[(resolve(c["href"], base) if k == "job_url" else resolve(c["company_href"], base) if k == "company_url" else t.clean(c[k])).alias(k) for k in LINK_COLUMNS])
    kept = F.transform(F.filter("cards", lambda c: c["href"].isNotNull()), card)
    return found.withColumn("max_page", t.max_page("paginator")).withColumn("cards", kept).drop("paginator")


def cards(parsed: DataFrame) -> DataFrame:
    """One row for each card of parsed search pages, with its position `pos` on the page."""
    rest = [c for c in parsed.columns if c != "cards"]
    return parsed.select(*rest, F.posexplode("cards").alias("pos", "card")).select(*rest, "pos", "card.*")


def _job(page: Page) -> dict:
    text = lambda n: None if n is None else n.text()
    sections = []
    for sec in page.all("section"):
        value = page.first("section_value", sec)
        sections.append({"title": text(page.first("section_title", sec)), "has_value": value is not None, "value": text(value), "text": sec.text()})
    blocks = [{"title": text(page.first("block_title", b)), "text": c.text()} for b in page.all("block") if (c := page.first("block_content", b)) is not None]
    headings = []
    for h in page.all("heading"):
        item = h.above(lambda n: ITEM_CLASS in n.classes)
        headings.append({"title": h.text(), "texts": [] if item is None else [n.text() for n in page.all("places", item)]})
    link = page.first("company") or page.first("company_else")
    return {
        "title": text(page.first("title")), "sections": sections, "deadlines": [n.text() for n in page.all("deadline")], "tags": [n.text() for n in page.all("tag")],
        "blocks": blocks, "headings": headings, "company_href": None if link is None else link.attrs.get("href"),
    }


_JOB = Selectors(JOB)
_JOB_SCHEMA = "title string, sections array<struct<title: string, has_value: boolean, value: string, text: string>>, deadlines array<string>, tags array<string>, blocks array<struct<title: string, text: string>>, headings array<struct<title: string, texts: array<string>>>, company_href string"


def _info(sections: Column, title: str) -> Column:
    """The value of the first section with a title; a section without a value node gives its whole text."""
    s = F.try_element_at(F.filter(sections, lambda x: F.lower(F.coalesce(t.clean(x["title"]), F.lit(""))) == title.lower()), F.lit(1))
    return F.when(s["has_value"], t.clean(s["value"])).otherwise(t.clean(s["text"]))


def _cleaned(texts: Column) -> Column:
    return F.filter(F.transform(texts, t.clean), lambda x: x.isNotNull())


def _under(headings: Column, phrase: str) -> Column:
    """Texts under every heading that holds a phrase; repeats of nested nodes stay."""
    return _cleaned(F.flatten(F.transform(F.filter(headings, lambda h: t.clean(h["title"]).contains(phrase)), lambda h: h["texts"])))


def job_details(pages: DataFrame, base: str = BASE, error: str | None = None) -> DataFrame:
    """Job pages (job_url, html, ...) to their twelve fields, html dropped; a page that fails gives nulls, and its error in a
    column of that name, if one is asked for."""
    found = with_parsed(pages, _JOB, _job, _JOB_SCHEMA, error=error)
    p = lambda c: F.col(f"parsed.{c}")
    blocks = F.transform(p("blocks"), lambda b: F.struct(F.coalesce(t.clean(b["title"]), F.lit("")).alias("title"), t.clean(b["text"]).alias("text")))
    fields = {
        "detail_title": t.clean(p("title")), "detail_salary": _info(p("sections"), SALARY), "detail_location": _info(p("sections"), LOCATION), "detail_experience": _info(p("sections"), EXPERIENCE),
        "deadline": t.deadline(_cleaned(p("deadlines"))), "tags": t.joined(_cleaned(p("tags"))),
        "desc_mota": t.last_text(blocks, TASKS), "desc_yeucau": t.last_text(blocks, NEEDS), "desc_quyenloi": t.last_text(blocks, BENEFITS),
        "working_addresses": t.joined(_under(p("headings"), PLACES)), "working_times": t.joined(_under(p("headings"), TIMES)), "company_url_from_job": resolve(p("company_href"), base),
    }
    return found.select(*[c for c in found.columns if c != "parsed"], *[v.alias(k) for k, v in fields.items()])


def _company(page: Page) -> dict:
    names = [(n.attrs.get("content") if n.tag == "meta" else n.text()) if (n := page.first(css)) is not None else None for css in NAMES]
    box = next((n for css in BOXES if (n := page.first(css)) is not None), None)
    rows = []
    for row in page.all(ROWS, box):
        bold = page.first(BOLD, row)
        rows.append({"bold": None if bold is None else bold.text(), "has_bold": bold is not None, "text": row.text()})
    return {"names": names, "rows": rows, "about": [n.text() if (n := page.first(css)) is not None else None for css in ABOUT]}


_COMPANY = Selectors({css: css for css in [*NAMES, *BOXES, ROWS, *ABOUT, BOLD]})
_COMPANY_SCHEMA = "names array<string>, rows array<struct<bold: string, has_bold: boolean, text: string>>, about array<string>"


def companies(pages: DataFrame, error: str | None = None) -> DataFrame:
    """Company pages (company_url_eff, html, ...) to their six fields, html dropped; a page that fails gives nulls, and its
    error as in job_details."""
    found = with_parsed(pages, _COMPANY, _company, _COMPANY_SCHEMA, error=error)
    names = [F.nullif(F.col("parsed.names")[k], F.lit("")) if css.startswith("meta") else t.clean(F.col("parsed.names")[k]) for k, css in enumerate(NAMES)]

    def pair(r: Column) -> Column:
        row, bold = F.coalesce(t.clean(r["text"]), F.lit("")), t.clean(r["bold"])
        label = F.when(r["has_bold"], bold).otherwise(t.label_part(row))
        value = F.when(r["has_bold"], t.without_label(row, bold)).otherwise(t.value_part(row))
        return F.struct(t.company_field(label).alias("field"), F.nullif(label, F.lit("")).alias("label"), F.nullif(value, F.lit("")).alias("value"))

    pairs = F.filter(F.transform("parsed.rows", pair), lambda r: r["label"].isNotNull() & r["value"].isNotNull())
    last = lambda f: F.try_element_at(F.filter("__pairs", lambda r: r["field"] == f), F.lit(-1))["value"]
    out = found.withColumn("__pairs", pairs)
    fields = {
        "company_name_full": t.without_brand(F.coalesce(*names)), "company_website": last("website"), "company_size": last("size"), "company_industry": last("industry"),
        "company_address": last("address"), "company_description": F.coalesce(*[t.clean(F.col("parsed.about")[k]) for k in range(len(ABOUT))]),
    }
    return out.select(*[c for c in found.columns if c != "parsed"], *[v.alias(k) for k, v in fields.items()])
