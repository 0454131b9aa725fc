"""Avature portals: HTML search pages with article context, detail pages with long fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import html as H
from postlake.functions import urls as U
from postlake.functions import variants as V
from postlake.functions.dates import iso_date
from postlake.functions.entities import unescape, unescape_sql
from postlake.functions.sqltext import bind, each_sql, keep_sql, let_sql, q
from postlake.functions.text import nonempty
from postlake.operators.assemble import attach_details, first_by_id
from postlake.sources import common

SOURCE = "avature"

# Link shapes, and the labels that name each field on detail pages.
ID_IN_PATH = r"/(JobDetail|FolderDetail)/[^/?#]+/(\d+)/?$"
BARE_PATH = r"/(JobDetail|FolderDetail)$"
LOCATION_LABELS = ["primary location", "job location", "location", "locations"]
EMPLOYMENT_LABELS = ["employment type", "job type", "work type"]
DEPARTMENT_LABELS = ["business area", "business function", "department", "team", "category"]


def detail_link_sql(href: str) -> str:
    """STRUCT<id, kind> of a posting link; the id is NULL when the link is none."""

    def describe(u: str) -> str:
        def last(name: str) -> str:
            return f"nullif({U.query_param_sql(f'{u}.whole', name)}, '')"

        in_path = f"nullif(regexp_extract({u}.parts.path, {q(ID_IN_PATH)}, 2), '')"
        bare = f"{u}.parts.path rlike {q(BARE_PATH)}"
        in_query = f"if({bare}, coalesce({last('jobId')}, {last('folderId')}), null)"
        kind = (
            f"case when {in_path} is not null then regexp_extract({u}.parts.path, {q(ID_IN_PATH)}, 1)"
            f" when {U.query_param_sql(f'{u}.whole', 'folderId')} is not null then 'FolderDetail' else 'JobDetail' end"
        )
        return f"named_struct('id', coalesce({in_path}, {in_query}), 'kind', {kind})"

    both = let_sql(
        unescape_sql(href), lambda h: f"named_struct('whole', {h}, 'parts', {U.split_url_sql(h)})"
    )
    return let_sql(both, describe)


def detail_link(href: Column | str) -> Column:
    return bind(href, detail_link_sql)


def posting_links(html: Column | str) -> Column:
    """Posting links of a search page with the text of the article around each.

    An article's texts are taken once, whatever the number of its links.
    """

    def pick(p: str) -> str:
        texts = each_sql(
            f"{p}.page.articles",
            lambda t: f"named_struct('location', {H.article_footer_sql(t, 'icon-address')}, 'department', {H.article_footer_sql(t, 'icon-tag')},"
            f" 'description', {H.article_content_sql(t)})",
        )
        described = each_sql(
            f"{p}.page.links",
            lambda a: f"named_struct('href', {H.attribute_sql(f'{a}.attrs', 'href')}, 'title',"
            f" coalesce(nullif({H.attribute_sql(f'{a}.attrs', 'title')}, ''), {H.strip_html_sql(f'{a}.inner', True)}),"
            f" 'article', {a}.article)",
        )
        filled = keep_sql(described, lambda a: f"{a}.href <> '' and {a}.title <> ''")
        linked = each_sql(
            filled, lambda a: f"named_struct('link', {detail_link_sql(f'{a}.href')}, 'a', {a})"
        )
        found = keep_sql(linked, lambda x: f"{x}.link.id is not null")

        def finish(t: str) -> str:
            return each_sql(
                found,
                lambda x: f"named_struct('id', {x}.link.id, 'kind', {x}.link.kind, 'title', {x}.a.title, 'href', {x}.a.href,"
                f" 'location', get({t}, {x}.a.article).location, 'department', get({t}, {x}.a.article).department,"
                f" 'description', get({t}, {x}.a.article).description)",
            )

        return let_sql(texts, finish)

    page = H.linked_articles(F.col(html) if isinstance(html, str) else html)
    return bind(F.struct(page.alias("page")), pick)


def detail_fields(pages: DataFrame) -> DataFrame:
    """Detail pages with the columns the fallback chains read."""
    staged = pages.withColumns(
        {
            "posting": H.json_ld_posting("body"),
            "dl": H.label_pairs("body", H.DT_DD),
            "divs": H.label_pairs("body", H.LABEL_VALUE_DIVS),
            "plain": H.strip_html("body", drop_scripts=True),
        }
    )
    return staged


def parse_avature(captures: DataFrame, rules: DataFrame) -> DataFrame:
    pages = common.list_pages(captures, rules, SOURCE, posting_links("body").alias("found"))
    summaries = common.exploded(
        pages, "found", "a", "run_id", "company", "company_ord", "page_no", "fetched_at", "url",
    ).select(
        "run_id", "company", "company_ord", "page_no", "pos", "fetched_at", "url",
        F.col("a.id").alias("summary_id"),
        F.col("a.title").alias("summary_title"),
        F.col("a.href").alias("href"),
        F.col("a.location").alias("summary_location"),
        F.col("a.department").alias("summary_department"),
        F.col("a.description").alias("summary_description"),
    )
    unique = first_by_id(summaries, "summary_id").withColumn(
        "detail_key", U.resolve_url("url", unescape("href"))
    )
    posting = "posting"
    only_details = captures.where((F.col("source_type") == SOURCE) & (F.col("kind") == "detail"))
    found = common.details(
        detail_fields(only_details),
        rules,
        SOURCE,
        F.coalesce(
            V.text(posting, "title"),
            nonempty(H.meta_content("body", "og:title")),
            nonempty(H.heading("body")),
        ).alias("d_title"),
        F.coalesce(
            H.expanded_locations("body"),
            nonempty(H.json_ld_location(V.sub(posting, "jobLocation"), street_fallback=True)),
            H.labelled_field("dl", "divs", "plain", LOCATION_LABELS),
        ).alias("d_location"),
        F.coalesce(
            nonempty(H.strip_html(V.text(posting, "description"), drop_scripts=True)),
            nonempty(H.page_description("body")),
        ).alias("d_description"),
        F.coalesce(
            nonempty(H.json_ld_employment(V.sub(posting, "employmentType"))),
            H.labelled_field("dl", "divs", "plain", EMPLOYMENT_LABELS),
        ).alias("d_employment"),
        H.labelled_field("dl", "divs", "plain", DEPARTMENT_LABELS).alias("d_department"),
        V.text(posting, "url").alias("d_url"),
        H.json_ld_identifier(V.sub(posting, "identifier")).alias("d_id"),
        iso_date(V.text(posting, "datePosted")).alias("d_date"),
    )
    staged = attach_details(unique, found).withColumn(
        "shown_title", F.coalesce("d_title", "summary_title")
    )
    url = F.coalesce("d_url", "detail_key")
    return common.postings(
        staged,
        SOURCE,
        title=H.strip_html("shown_title", drop_scripts=True),
        location=F.coalesce("d_location", "summary_location"),
        employment_type=F.col("d_employment"),
        department=F.coalesce("d_department", "summary_department"),
        description=F.coalesce("d_description", "summary_description"),
        posting_url=url,
        application_url=url,
        source_job_id=F.coalesce("d_id", "summary_id"),
        date_posted=F.col("d_date"),
    )
