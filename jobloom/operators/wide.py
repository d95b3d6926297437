"""The wide job table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .extract import COMPANY_COLUMNS, DETAIL_COLUMNS

# The order of the columns.
WIDE_COLUMNS = [
    "title", "detail_title", "job_url", "company", "company_name_full", "company_url", "company_url_from_job", "salary_list", "detail_salary", "address_list", "detail_location",
    "exp_list", "detail_experience", "deadline", "tags", "working_addresses", "working_times", "desc_mota", "desc_yeucau", "desc_quyenloi",
    "company_website", "company_size", "company_industry", "company_address", "company_description",
]


def _one_each(records: DataFrame, key: str, columns: list[str], time: str = "fetched_at") -> DataFrame:
    """One record of each key, on the partitioning that the join needs anyway: one with any field set before one of a failed
    page (all null), then the newest (where records have the column `time`), then the least."""
    failed = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()
    age = F.coalesce(-F.unix_micros(F.col(time).cast("timestamp")), F.lit((1 << 63) - 1)) if time in records.columns else F.lit(0)
    best = F.min(F.struct(failed.alias("__failed"), age.alias("__age"), *columns)).alias("r")
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[f"r.{c}" for c in columns])


def job_wide(found: DataFrame, details: DataFrame, companies: DataFrame) -> DataFrame:
    """Cards with the detail of their job and the record of its company (the job page's link, else the card's).

    A card keeps one row: of several details of one job_url (or records of one company) a good one counts before one of a
    failed page, a newer one (`fetched_at`, if there is such a column) before an older one; a card without either keeps its
    row with nulls.
    Rows without a company address don't take part in the second join, so they can't pile up in one task.
    """
    with_detail = found.join(_one_each(details, "job_url", DETAIL_COLUMNS), "job_url", "left")
    keyed = with_detail.withColumn("company_url_eff", F.coalesce(F.nullif("company_url_from_job", F.lit("")), F.nullif("company_url", F.lit(""))))
    named = keyed.where("company_url_eff is not null").join(_one_each(companies, "company_url_eff", COMPANY_COLUMNS), "company_url_eff", "left")
    bare = keyed.where("company_url_eff is null").select("*", *[F.lit(None).cast("string").alias(c) for c in COMPANY_COLUMNS])
    return named.unionByName(bare).select(*WIDE_COLUMNS)


def relational(wide: DataFrame) -> DataFrame:
    """title, company, location, description and posted_date (not known from pages) of wide rows."""
    return wide.select(
        F.coalesce("detail_title", "title").alias("title"), F.coalesce("company_name_full", "company").alias("company"), F.coalesce("detail_location", "address_list").alias("location"),
        F.col("desc_mota").alias("description"), F.lit(None).cast("date").alias("posted_date"))
