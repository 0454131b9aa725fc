"""Table jobs: normal forms, canonical URLs, page fields, links, dates and flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import dates as D
from postlake.functions import html as H
from postlake.functions import urls as U
from postlake.functions import variants as V
from postlake.functions import xml as X
from postlake.functions.entities import unescape
from postlake.functions.text import (
    location_from_norm,
    nonempty,
    norm_text,
    title_from_norm,
)
from postlake.operators.assemble import next_page
from postlake.operators.rules import job_text


def normalise_postings(df: DataFrame) -> DataFrame:
    """Normal forms of company, title, location and of the joined text."""
    staged = df.withColumns(
        {
            "norm_company": norm_text("company"),
            "_title": norm_text("title"),
            "_location": norm_text("location"),
            "_description": norm_text("description"),
            "_department": norm_text("department"),
            "_employment": norm_text("employment_type"),
        }
    )
    out = staged.withColumns(
        {
            "norm_title": title_from_norm("_title"),
            "norm_location": location_from_norm("_location"),
            "norm_text": job_text("_title", "_description", "_department", "_location", "_employment"),
        }
    )
    return out.drop("_title", "_location", "_description", "_department", "_employment")


def equal_forms(normalised: DataFrame) -> DataFrame:
    """Sizes of the groups of postings with the same normal text.

    Texts are hashed before the exchange, which then moves 32 bytes per row, pre-summed per task.
    """
    hashed = normalised.select(F.sha2("norm_text", 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))


def canonical_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URL, its hash, and how many rows and raw spellings share it."""
    spelled = df.groupBy(F.col(url).alias("raw_url")).agg(F.count(F.lit(1)).alias("n"))
    canonical = spelled.withColumn("canonical_url", U.norm_url("raw_url"))
    return canonical.groupBy("canonical_url").agg(
        F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_rows")
    ).withColumn("url_hash", U.short_hash("canonical_url"))


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, heading, description, text, labelled fields and JSON-LD posting, one row per page."""
    staged = pages.withColumns(
        {
            "page_title": H.page_title(html),
            "h1": H.heading(html),
            "meta_description": H.meta_content(html, "description"),
            "plain": H.strip_html(html, drop_scripts=True),
            "posting": H.json_ld_posting(html),
            "dl": H.label_pairs(html, H.DT_DD),
            "divs": H.label_pairs(html, H.LABEL_VALUE_DIVS),
        }
    )
    return staged.withColumns(
        {
            "posting_title": V.text("posting", "title"),
            "posting_id": H.json_ld_identifier(V.sub("posting", "identifier")),
            "posting_location": H.json_ld_location(V.sub("posting", "jobLocation"), True),
            "field_location": H.labelled_field("dl", "divs", "plain", ["location", "locations"]),
            "field_department": H.labelled_field("dl", "divs", "plain", ["department", "team"]),
            "description": F.coalesce(
                nonempty(H.strip_html(V.text("posting", "description"), True)),
                nonempty(H.page_description(html)),
            ),
        }
    ).drop(html, "posting", "dl", "divs")


# Fixed value: path words of posting pages.
POSTING_KIND = r"(?i)/(jobdetail|folderdetail|jobs?)(?:/|$)"


def link_table(pages: DataFrame, html: str = "html", url: str = "url", page_no: str | None = None) -> DataFrame:
    """One row per link: position, resolved URL, text, id, kind, and whether it is the next page.

    `kind` is the path word that marks a posting's page (job, jobs, jobdetail, folderdetail), or NULL.
    """
    others = [c for c in pages.columns if c not in (html,)]
    following = next_page(html, url)
    rows = pages.select(
        *others,
        following.alias("following"),
        F.posexplode(
            F.transform(
                H.links(html),
                lambda a: F.struct(
                    H.attribute(a["attrs"], "href").alias("href"),
                    H.strip_html(a["inner"]).alias("text"),
                ),
            )
        ).alias("pos", "a"),
    ).where("a.href <> ''")
    resolved = rows.withColumn("link", U.resolve_url(url, unescape("a.href")))
    return resolved.select(
        *others,
        "pos",
        F.col("a.text").alias("text"),
        "link",
        nonempty(F.regexp_extract(U.split_url("link")["path"], r"/(\d+)/?$", 1)).alias("link_id"),
        nonempty(F.lower(F.regexp_extract(U.split_url("link")["path"], POSTING_KIND, 1))).alias("kind"),
        F.coalesce(F.col("link") == F.col("following"), F.lit(False)).alias("is_next_page"),
    )


def harmonise_dates(df: DataFrame, column: str, anchor: Column | str) -> DataFrame:
    """DATE and the notation it was written in."""
    notation = D.date_notation(column)
    staged = df.withColumn("notation", notation)
    kind = F.col("notation")
    date = (
        F.when(kind == "relative", D.relative_date(column, anchor))
        .when(kind == "epoch_ms", D.epoch_ms_date(column))
        .when(kind == "epoch_s", D.epoch_s_date(column))
        .otherwise(D.any_date(column))
    )
    return staged.withColumn("date", date)


def flatten_records(
    captures: DataFrame, list_key: str, aliases: dict[str, list[str]]
) -> tuple[DataFrame, DataFrame]:
    """Records of JSON and XML captures with alias-resolved text fields, and the rejected captures.

    `list_key` names the JSON list; XML documents are recognised by their start. A capture that is
    neither or broken, or whose JSON has no such list, is rejected.
    """
    keep = [c for c in captures.columns if c != "body"]
    typed = captures.withColumn("is_xml", X.is_xml("body"))
    json_docs = typed.where(~F.col("is_xml")).withColumn("doc", F.try_parse_json("body"))
    listed = json_docs.withColumn("records", F.coalesce(V.items("doc", list_key), V.items("doc")))
    json_rows = (
        listed.where("records is not null")
        .select(*keep, F.posexplode("records").alias("pos", "v"))
        .where(V.is_object("v"))
        .select(*keep, "pos", *[V.first_text("v", *names).alias(n) for n, names in aliases.items()])
    )
    feeds = typed.where("is_xml").withColumn("feed", X.xml_feed("body"))
    xml_rows = (
        feeds.where("feed.error is null")
        .select(*keep, F.posexplode("feed.records").alias("pos", "f"))
        .select(
            *keep,
            "pos",
            *[
                X.first_field("f", *[n.lower().replace("_", "") for n in names]).alias(name)
                for name, names in aliases.items()
            ],
        )
    )
    rejects = listed.where("records is null").select(
        *keep, F.when(F.col("doc").isNull(), F.lit("unreadable")).otherwise(F.lit("no list")).alias("reason")
    )
    broken = feeds.where("feed.error is not null").select(*keep, F.lit("unreadable").alias("reason"))
    return json_rows.unionByName(xml_rows), rejects.unionByName(broken)
