"""iCIMS sites: HTML search pages, one JSON-LD detail page per posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import html as H
from postlake.functions import urls as U
from postlake.functions import variants as V
from postlake.functions.dates import iso_date
from postlake.functions.entities import unescape
from postlake.functions.sqltext import bind, each_sql, keep_sql, q
from postlake.operators.assemble import attach_details, first_by_id
from postlake.sources import common

SOURCE = "icims"

# Where the posting id sits, and links that are no postings.
ID_IN_URL = r"/jobs/(\d+)/"
NO_POSTING = r"/login|/referral|mode=apply"


def is_posting_link_sql(href: str) -> str:
    lowered = f"lower({href})"
    return (
        f"(contains({lowered}, '/jobs/') and contains({lowered}, '/job')"
        f" and not {lowered} rlike {q(NO_POSTING)})"
    )


def posting_links(html: Column | str) -> Column:
    """ARRAY<STRUCT<id, title, href>> of the posting links of a search page."""

    def pick(h: str) -> str:
        described = each_sql(
            H.links_sql(h),
            lambda a: f"named_struct('href', {H.attribute_sql(f'{a}.attrs', 'href')}, 'title',"
            f" coalesce(nullif({H.attribute_sql(f'{a}.attrs', 'title')}, ''), {H.strip_html_sql(f'{a}.inner')}))",
        )
        qualified = keep_sql(
            described, lambda a: f"{is_posting_link_sql(f'{a}.href')} and {a}.title <> ''"
        )
        identified = each_sql(
            qualified,
            lambda a: f"named_struct('id', regexp_extract({a}.href, {q(ID_IN_URL)}, 1),"
            f" 'title', {a}.title, 'href', {a}.href)",
        )
        return keep_sql(identified, lambda a: f"{a}.id <> ''")

    return bind(html, pick)


def parse_icims(captures: DataFrame, rules: DataFrame) -> DataFrame:
    pages = common.list_pages(captures, rules, SOURCE, posting_links("body").alias("found"))
    summaries = common.exploded(
        pages, "found", "a", "run_id", "company", "company_ord", "page_no", "fetched_at", "url",
    ).select(
        "run_id", "company", "company_ord", "page_no", "pos", "fetched_at", "url",
        F.col("a.id").alias("source_job_id"),
        F.col("a.title").alias("summary_title"),
        F.col("a.href").alias("href"),
    )
    unique = first_by_id(summaries).withColumn(
        "detail_key", U.resolve_url("url", unescape("href"))
    )
    posting = "posting"
    found = common.details(
        captures.withColumn("posting", H.json_ld_posting("body")),
        rules,
        SOURCE,
        V.text(posting, "title").alias("d_title"),
        H.json_ld_location(V.sub(posting, "jobLocation")).alias("d_location"),
        H.strip_html(V.text(posting, "description")).alias("d_description"),
        H.json_ld_employment(V.sub(posting, "employmentType")).alias("d_employment"),
        V.text(posting, "url").alias("d_url"),
        iso_date(V.text(posting, "datePosted")).alias("d_date"),
    )
    url = F.coalesce("d_url", "detail_key")
    return common.postings(
        attach_details(unique, found),
        SOURCE,
        title=F.coalesce("d_title", "summary_title"),
        location=F.col("d_location"),
        employment_type=F.col("d_employment"),
        department=F.lit(None).cast("string"),
        description=F.col("d_description"),
        posting_url=url,
        application_url=url,
        date_posted=F.col("d_date"),
    )
