"""Greenhouse boards: one JSON document per company, `jobs[]`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions import variants as V
from postlake.functions.dates import iso_date
from postlake.sources import common

SOURCE = "greenhouse"


def parse_greenhouse(captures: DataFrame, rules: DataFrame) -> DataFrame:
    jobs = F.from_json("body", "struct<jobs:array<variant>>")["jobs"].alias("jobs")
    pages = common.list_pages(captures, rules, SOURCE, jobs).select(
        "run_id", "company", "company_ord", "page_no", "fetched_at", "jobs"
    )
    rows = common.explode_objects(pages, "jobs")
    v = "v"
    url = V.text(v, "absolute_url")
    return common.postings(
        rows,
        SOURCE,
        title=F.coalesce(V.text(v, "title"), F.lit(common.UNTITLED)),
        location=V.raw_text(v, "location", "name"),
        employment_type=V.raw_text(v, "metadata", "employment_type"),
        department=F.try_variant_get("v", "$.departments[0].name", "string"),
        description=V.text(v, "content"),
        posting_url=url,
        application_url=url,
        source_job_id=V.text(v, "id"),
        date_posted=iso_date(V.text(v, "updated_at")),
    )
