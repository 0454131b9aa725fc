"""SuccessFactors: XML feeds, or HTML search tables with a detail page per posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import html as H
from postlake.functions import urls as U
from postlake.functions import xml as X
from postlake.functions.dates import any_date
from postlake.functions.entities import unescape, unescape_sql
from postlake.functions.sqltext import bind, each_sql, keep_sql, q
from postlake.functions.text import nonempty
from postlake.operators.assemble import attach_details, drop_requisition_repeats, first_by_id
from postlake.sources import common

SOURCE = "successfactors"

# Feed fields by alias, in order of priority.
TITLE_KEYS = ["title", "jobtitle", "name"]
ID_KEYS = ["referencenumber", "reference", "id", "jobid", "jobreqid", "requisitionid"]
URL_KEYS = ["url", "link", "joburl", "applyurl"]
DESCRIPTION_KEYS = ["description", "jobdescription", "summary"]
EMPLOYMENT_KEYS = ["employmenttype", "jobtype", "type"]
DEPARTMENT_KEYS = ["department", "division", "category", "function"]
DATE_KEYS = ["date", "posteddate", "dateposted"]


def url_id_sql(url: str) -> str:
    """Number at the end of the path, NULL when there is none."""
    path = unescape_sql(f"{U.split_url_sql(url)}.path")
    return f"nullif(regexp_extract({path}, {q(r'/(\d+)/?$')}, 1), '')"


def url_id(url: Column | str) -> Column:
    return bind(url, url_id_sql)


def table_rows(html: Column | str) -> Column:
    """ARRAY<STRUCT<id, title, location, href>> of the rows of a search table."""

    def pick(h: str) -> str:
        described = each_sql(
            f"regexp_extract_all({h}, {q(H.DATA_ROW)}, 1)",
            lambda row: f"named_struct('href', {H.quoted_attribute_sql(H.matched_sql(row, H.TITLE_LINK, 1), 'href')},"
            f" 'title', {H.strip_html_sql(H.matched_sql(row, H.TITLE_LINK, 2))},"
            f" 'location', nullif({H.strip_html_sql(H.matched_sql(row, H.LOCATION_CELL))}, ''))",
        )
        identified = each_sql(
            keep_sql(described, lambda r: f"{r}.href <> ''"),
            lambda r: f"named_struct('id', {url_id_sql(f'{r}.href')}, 'title', {r}.title,"
            f" 'location', {r}.location, 'href', {r}.href)",
        )
        return keep_sql(identified, lambda r: f"{r}.id is not null")

    return bind(html, pick)


def parse_successfactors_xml(captures: DataFrame, rules: DataFrame) -> DataFrame:
    feeds = captures.where(X.is_xml("body"))
    pages = common.list_pages(feeds, rules, SOURCE, X.xml_feed("body").alias("feed"))
    fields = common.exploded(
        pages, "feed.records", "f", "run_id", "company", "company_ord", "page_no", "fetched_at"
    )
    url = X.first_field("f", *URL_KEYS)
    staged = fields.withColumns(
        {
            "raw_title": F.coalesce(X.first_field("f", *TITLE_KEYS), F.lit(common.UNTITLED)),
            "raw_description": X.first_field("f", *DESCRIPTION_KEYS),
            "raw_date": X.first_field("f", *DATE_KEYS),
        }
    )
    return common.postings(
        staged,
        SOURCE,
        title=H.strip_html("raw_title"),
        location=X.xml_location("f"),
        employment_type=X.first_field("f", *EMPLOYMENT_KEYS),
        department=X.first_field("f", *DEPARTMENT_KEYS),
        description=nonempty(H.strip_html("raw_description")),
        posting_url=url,
        application_url=url,
        source_job_id=X.first_field("f", *ID_KEYS),
        date_posted=any_date("raw_date"),
    )


def parse_successfactors_html(captures: DataFrame, rules: DataFrame) -> DataFrame:
    boards = captures.where(~X.is_xml("body"))
    pages = common.list_pages(boards, rules, SOURCE, table_rows("body").alias("found"))
    summaries = common.exploded(
        pages, "found", "a", "run_id", "company", "company_ord", "page_no", "fetched_at", "url", "fetch_details",
    ).select(
        "run_id", "company", "company_ord", "page_no", "pos", "fetched_at", "url", "fetch_details",
        F.col("a.id").alias("summary_id"),
        F.col("a.title").alias("summary_title"),
        F.col("a.location").alias("summary_location"),
        F.col("a.href").alias("href"),
    )
    unique = first_by_id(summaries, "summary_id").withColumn(
        "link", U.resolve_url("url", unescape("href"))
    )
    keyed = unique.withColumn("detail_key", F.when(F.col("fetch_details"), F.col("link")))
    only_details = captures.where((F.col("source_type") == SOURCE) & (F.col("kind") == "detail"))
    described = only_details.withColumn(
        "lines", H.strip_html_lines(F.coalesce(H.matched("body", H.DESCRIPTION_SPAN), F.lit("")))
    )
    found = common.details(
        described,
        rules,
        SOURCE,
        nonempty(H.strip_html(H.matched("body", H.TITLE_SPAN))).alias("d_title"),
        H.line_field("lines", "Location").alias("d_location"),
        H.line_field("lines", "Employment Type").alias("d_employment"),
        H.line_field("lines", "Work Area").alias("d_department"),
        H.line_field("lines", "Requisition ID").alias("requisition"),
        any_date(H.line_field("lines", "Original Posting Date")).alias("d_date"),
        nonempty("lines").alias("d_description"),
    )
    joined = attach_details(keyed, found)
    settled = drop_requisition_repeats(joined, "summary_id", "requisition")
    return common.postings(
        settled,
        SOURCE,
        stable_job_id=F.col("summary_id"),
        title=F.coalesce("d_title", nonempty("summary_title"), F.lit(common.UNTITLED)),
        location=F.coalesce("d_location", "summary_location"),
        employment_type=F.col("d_employment"),
        department=F.col("d_department"),
        description=F.col("d_description"),
        posting_url=F.col("link"),
        application_url=F.col("link"),
        source_job_id=F.coalesce("requisition", "summary_id"),
        date_posted=F.col("d_date"),
    )


def parse_successfactors(captures: DataFrame, rules: DataFrame) -> DataFrame:
    return parse_successfactors_xml(captures, rules).unionByName(
        parse_successfactors_html(captures, rules)
    )
