"""Ashby boards: one JSON document, `jobs[]`, several fields either text or object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import variants as V
from postlake.functions.dates import iso_date
from postlake.sources import common

SOURCE = "ashby"


def _name_or_text(v: str, key: str) -> Column:
    """Name of an object, or the text itself."""
    plain = F.when(~V.is_object(V.sub(v, key)), V.text(v, key))
    return F.coalesce(V.raw_text(v, key, "name"), plain)


def parse_ashby(captures: DataFrame, rules: DataFrame) -> DataFrame:
    jobs = F.from_json("body", "struct<jobs:array<variant>>")["jobs"].alias("jobs")
    pages = common.list_pages(captures, rules, SOURCE, jobs).select(
        "run_id", "company", "company_ord", "page_no", "fetched_at", "jobs"
    )
    rows = common.explode_objects(pages, "jobs")
    v = "v"
    job_url = V.first_text(v, "jobUrl", "job_url", "externalLink")
    return common.postings(
        rows,
        SOURCE,
        title=F.coalesce(V.text(v, "title"), F.lit(common.UNTITLED)),
        location=_name_or_text(v, "location"),
        employment_type=V.first_text(v, "employmentType", "employment_type"),
        department=_name_or_text(v, "department"),
        description=V.first_text(v, "descriptionPlain", "descriptionHtml", "description"),
        posting_url=job_url,
        application_url=F.coalesce(V.first_text(v, "applyUrl", "apply_url"), job_url),
        source_job_id=V.raw_text(v, "id"),
        date_posted=iso_date(V.first_text(v, "publishedDate", "createdAt")),
    )
