"""Lever boards: a JSON array, or an object with `postings[]`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions import variants as V
from postlake.functions.dates import epoch_ms_date
from postlake.sources import common

SOURCE = "lever"


def parse_lever(captures: DataFrame, rules: DataFrame) -> DataFrame:
    document = F.try_parse_json("body").alias("doc")
    documents = common.list_pages(captures, rules, SOURCE, document).select(
        "run_id", "company", "company_ord", "page_no", "fetched_at", "doc"
    )
    pages = documents.withColumn(
        "jobs", F.coalesce(V.items("doc"), V.items("doc", "postings"))
    ).drop("doc")
    rows = common.explode_objects(pages, "jobs")
    v = "v"
    sections = F.transform(V.items(v, "lists"), lambda item: V.text(item, "content"))
    opening = V.first_text(v, "descriptionPlain", "description")
    hosted = V.first_text(v, "hostedUrl", "hosted_url")
    job_id = V.raw_text(v, "id")
    return common.postings(
        rows,
        SOURCE,
        title=F.coalesce(V.text(v, "text"), F.lit(common.UNTITLED)),
        location=V.raw_text(v, "categories", "location"),
        employment_type=V.raw_text(v, "categories", "commitment"),
        department=V.raw_text(v, "categories", "team"),
        description=F.concat_ws("\n", opening, sections),
        posting_url=hosted,
        application_url=F.coalesce(V.first_text(v, "applyUrl", "apply_url"), hosted),
        source_job_id=job_id,
        date_posted=epoch_ms_date(V.raw_text(v, "createdAt")),
    )
