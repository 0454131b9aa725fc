"""SmartRecruiters companies: paged JSON lists, `content[]`, with an optional detail per posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import urls as U
from postlake.functions import variants as V
from postlake.functions.dates import iso_date
from postlake.functions.entities import unescape
from postlake.functions.text import nonempty, strip
from postlake.operators.assemble import attach_details
from postlake.sources import common

SOURCE = "smartrecruiters"

# Rows per list page, site of the public postings, sections of a job advert.
PAGE_SIZE = 100
PUBLIC_SITE = "https://jobs.smartrecruiters.com/"
SECTIONS = ["companyDescription", "jobDescription", "qualifications", "additionalInformation"]


def detail_reference(v: Column, endpoint: Column) -> Column:
    """Where the detail of a list row lives: its reference, else the endpoint plus its id."""
    ref = V.sub(v, "ref")
    by_id = F.concat(
        F.regexp_replace(endpoint, "/+$", ""), F.lit("/"), V.first_text(v, "uuid", "id")
    )
    return F.coalesce(F.when(V.is_string(ref), V.scalar(ref)), V.text(ref, "url"), by_id)


def location_text(v: Column) -> Column:
    place = nonempty(
        F.concat_ws(", ", V.text(v, "city"), V.text(v, "region"), V.text(v, "country"))
    )
    remote = F.when(place.isNull(), F.lit("Remote")).otherwise(F.concat(place, F.lit(" (Remote)")))
    composed = F.when(V.truthy(V.sub(v, "remote")), remote).otherwise(place)
    return F.when(V.is_object(v), composed).otherwise(V.scalar(v))


def label(v: Column) -> Column:
    return F.when(V.is_object(v), V.text(v, "label")).otherwise(V.scalar(v))


def title_slug(title: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""
    )


def public_url(explicit: Column, posting_id: Column, title: Column, company: Column) -> Column:
    """The given URL when it already names one posting, else one built from company, id and title."""
    parts = U.split_url(explicit)
    depth = F.size(F.filter(F.split(parts["path"], "/"), lambda p: p != ""))
    individual = F.contains(F.lower(parts["authority"]), F.lit("smartrecruiters.com")) & (depth >= 2)
    quoted = F.url_encode(F.regexp_replace(company, "^/+|/+$", ""))
    quoted = F.replace(F.replace(quoted, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    built = F.concat(
        F.lit(PUBLIC_SITE), quoted, F.lit("/"), posting_id, F.lit("-"), title_slug(title)
    )
    return F.when(individual, explicit).otherwise(F.coalesce(built, explicit))


def parse_smartrecruiters(captures: DataFrame, rules: DataFrame) -> DataFrame:
    from_url = F.regexp_replace("careers_url", "/+$", "")
    document = F.from_json("body", "struct<content:array<variant>>").alias("doc")
    pages = common.list_pages(captures, rules, SOURCE, document).select(
        "run_id", "company", "company_ord", "page_no", "fetched_at", "fetch_details",
        F.coalesce(nonempty("api_endpoint"), F.substring_index("url", "?", 1)).alias("endpoint"),
        F.coalesce(
            nonempty("ats_identifier"), nonempty(F.substring_index(from_url, "/", -1))
        ).alias("site"),
        "doc",
    )
    listed = pages.withColumn("jobs", V.objects("doc.content")).drop("doc")
    kept = [c for c in listed.columns if c != "jobs"]
    rows = common.exploded(listed, "jobs", "raw", *kept).withColumn(
        "detail_key",
        F.when(F.col("fetch_details"), detail_reference(F.col("raw"), F.col("endpoint"))),
    )
    found = common.details(captures, rules, SOURCE, V.as_map(F.try_parse_json("body")).alias("detail"))
    merged = attach_details(rows, found).withColumn(
        "m", V.overlay(V.as_map("raw"), F.col("detail"))
    )
    job_id = V.entry_text("m", "uuid", "id")
    title = V.entry_text("m", "name", "title")
    url = public_url(
        V.entry_text("m", "jobAdUrl", "postingUrl", "url"),
        V.entry_text("m", "id", "uuid"),
        F.coalesce(title, F.lit("job")),
        F.col("site"),
    )
    advert = V.entry("m", "jobAd")
    sections = nonempty(F.concat_ws("\n", *[V.text(advert, s) for s in SECTIONS]))
    staged = merged.withColumns(
        {
            "title": F.coalesce(title, F.lit(common.UNTITLED)),
            "source_job_id": nonempty(strip(job_id)),
            "posting_url": url,
            "sections": F.when(V.is_object(advert), sections),
            "plain": F.when(~V.is_object(advert), V.entry_text("m", "description")),
        }
    )
    return common.postings(
        staged,
        SOURCE,
        location=location_text(V.entry("m", "location")),
        employment_type=label(V.entry("m", "typeOfEmployment")),
        department=F.coalesce(label(V.entry("m", "department")), label(V.entry("m", "function"))),
        description=F.coalesce(unescape("sections"), F.col("plain")),
        application_url=F.coalesce(V.entry_text("m", "applyUrl"), F.col("posting_url")),
        date_posted=iso_date(V.entry_text("m", "releasedDate", "postedDate")),
    )
