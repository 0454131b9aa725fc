"""Eightfold career sites: paged JSON lists, `data.positions[]`, with an optional detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import variants as V
from postlake.functions.dates import epoch_s_date
from postlake.functions.entities import unescape
from postlake.functions.text import nonempty, strip
from postlake.operators.assemble import attach_details
from postlake.sources import common

SOURCE = "eightfold"

# Rows per list page and the site that serves positions.
PAGE_SIZE = 10
PUBLIC_SITE = "https://app.eightfold.ai"


def location_text(v: Column) -> Column:
    listed = F.filter(F.transform(V.items(v), V.scalar), lambda x: x.isNotNull())
    joined = nonempty(F.array_join(listed, "; "))
    return F.when(V.is_array(v), joined).otherwise(V.scalar(v))


def public_url(position_url: Column, position_id: Column, domain: Column) -> Column:
    where = F.coalesce(position_url, F.concat(F.lit("/careers/job/"), position_id))
    return F.concat(F.lit(PUBLIC_SITE), where, F.lit("?domain="), domain)


def parse_eightfold(captures: DataFrame, rules: DataFrame) -> DataFrame:
    document = F.from_json("body", "struct<data:struct<positions:array<variant>>>")["data"].alias("doc")
    pages = common.list_pages(captures, rules, SOURCE, document).select(
        "run_id", "company", "company_ord", "page_no", "fetched_at", "fetch_details",
        F.coalesce(nonempty("ats_identifier"), nonempty("domain")).alias("domain"),
        "doc",
    )
    listed = pages.withColumn("jobs", V.objects("doc.positions")).drop("doc")
    rows = common.explode_objects(listed, "jobs", "raw").withColumn(
        "detail_key", F.when(F.col("fetch_details"), V.first_text("raw", "id", "atsJobId"))
    )
    found = common.details(
        captures, rules, SOURCE, V.as_map(V.sub(F.try_parse_json("body"), "data")).alias("detail")
    )
    merged = attach_details(rows, found).withColumn(
        "m", V.overlay(V.as_map("raw"), F.col("detail"))
    )
    job_id = V.entry_text("m", "id", "atsJobId")
    standard, plain = V.entry("m", "standardizedLocations"), V.entry("m", "locations")
    full_time = F.when(V.truthy(V.entry("m", "isFullTime")), F.lit("Full-time"))
    staged = merged.withColumns(
        {
            "posting_url": public_url(V.entry_text("m", "positionUrl"), job_id, F.col("domain")),
            "text": V.entry_text("m", "jobDescription", "description"),
        }
    )
    return common.postings(
        staged,
        SOURCE,
        title=F.coalesce(V.entry_text("m", "name"), F.lit(common.UNTITLED)),
        location=F.when(V.truthy(standard), location_text(standard)).otherwise(
            location_text(plain)
        ),
        employment_type=F.coalesce(V.entry_text("m", "employmentType", "employment_type"), full_time),
        department=V.entry_text("m", "department"),
        description=unescape("text"),
        application_url=F.col("posting_url"),
        source_job_id=nonempty(strip(job_id)),
        date_posted=epoch_s_date(V.entry_text("m", "postedTs", "creationTs")),
    )
