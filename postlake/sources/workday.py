"""Workday sites: paged JSON lists, `jobPostings[]`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import variants as V
from postlake.functions.dates import relative_date
from postlake.functions.text import nonempty, strip
from postlake.sources import common

SOURCE = "workday"

# Fixed value: rows per list page.
PAGE_SIZE = 20


def workday_url(site: Column, external_path: Column) -> Column:
    """Absolute links stay; paths are put after the careers site."""
    joined = F.concat(
        F.regexp_replace(site, "/+$", ""), F.lit("/"), F.regexp_replace(external_path, "^/+", "")
    )
    return F.when(external_path.rlike("^https?://"), external_path).otherwise(joined)


def parse_workday(captures: DataFrame, rules: DataFrame) -> DataFrame:
    document = F.from_json("body", "struct<jobPostings:array<variant>>").alias("doc")
    pages = common.list_pages(captures, rules, SOURCE, document).select(
        "run_id", "company", "company_ord", "page_no", "fetched_at",
        F.coalesce(nonempty("careers_url"), nonempty("api_endpoint"), F.col("url")).alias("site"),
        "doc",
    )
    listed = F.coalesce("doc.jobPostings", F.array().cast("array<variant>"))
    rows = common.explode_objects(pages.withColumn("jobs", listed).drop("doc"), "jobs")
    v = "v"
    described = F.filter(
        V.items(v, "jobPostingInfo", "jobDescriptionFields"),
        lambda f: F.lower(V.text(f, "label")).rlike("time type|employment"),
    )
    bullet = V.scalar(F.try_variant_get(v, "$.bulletFields[0]", "variant"))
    external_path = F.coalesce(V.text(v, "externalPath"), V.text(v, "jobPostingInfo", "externalUrl"))
    url = workday_url(F.col("site"), external_path)
    return common.postings(
        rows,
        SOURCE,
        title=F.coalesce(V.text(v, "title"), F.lit(common.UNTITLED)),
        location=V.first_text(v, "locationsText", "locationsDisplay", "location"),
        employment_type=V.text(F.try_element_at(described, F.lit(1)), "text"),
        department=V.first_text(v, "jobFamily", "jobFamilyGroup", "department"),
        description=V.first_text(v, "jobDescription", "jobDescriptionText"),
        posting_url=url,
        application_url=url,
        source_job_id=nonempty(strip(F.coalesce(bullet, V.text(v, "id")))),
        date_posted=relative_date(V.first_text(v, "postedOn", "startDate"), F.to_date("fetched_at")),
    )
