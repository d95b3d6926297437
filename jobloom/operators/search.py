"""Search crawls: which pages and cards count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.urls import url_hash, url_path
from .extract import LINK_COLUMNS, cards


def kept_pages(pages: DataFrame, by: str = "keyword_id", use_max_page: bool = True) -> DataFrame:
    """The pages that a crawl reads: up to the first page without cards, and up to the first that reaches its max_page.

    pages: one narrow row for each page (by, page_no, n_cards, max_page). The empty page goes, the one that reaches
    max_page stays.
    """
    w = Window.partitionBy(by).orderBy("page_no")
    empty = F.max(F.col("n_cards") == 0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = pages.withColumn("__stop", empty)
    if use_max_page:
        reached = F.max(F.col("page_no") >= F.col("max_page")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        kept = kept.withColumn("__stop", F.col("__stop") | F.coalesce(reached, F.lit(False)))
    return kept.where(~F.col("__stop")).drop("__stop")


def last_max_page(pages: DataFrame, end_page: int, by: str = "keyword_id") -> DataFrame:
    """The page count last seen in each crawl's kept pages; end_page for a crawl whose first page was empty."""
    kept = kept_pages(pages, by).groupBy(by).agg(F.max_by("max_page", "page_no").alias("max_page"))
    return pages.select(by).distinct().join(kept, by, "left").select(by, F.coalesce("max_page", F.lit(end_page)).alias("max_page"))


def first_seen(found: DataFrame, by: str = "keyword_id", order: tuple[str, ...] = ("page_no", "pos"), url: str = "job_url") -> DataFrame:
    """The first card of each job (path of its address) in a crawl."""
    w = Window.partitionBy(by, "__path").orderBy(*order)
    return found.withColumn("__path", url_path(url)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__path")


def search_links(parsed: DataFrame, by: str = "keyword_id", use_max_page: bool = True) -> DataFrame:
    """Link records of parsed search pages (by, page_no, max_page, cards): stop rules, first seen, key and hash.

    The stop rules run before any card is exploded, beside the cards: a join with the pages that stay would parse each page twice.
    """
    kept = kept_pages(parsed.withColumn("n_cards", F.size("cards")), by, use_max_page).drop("n_cards")
    found = first_seen(cards(kept), by)
    return found.select(by, "page_no", "pos", *LINK_COLUMNS).withColumn("url_hash", url_hash("job_url"))
