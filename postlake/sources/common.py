"""What the source parsers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import variants as V
from postlake.operators.assemble import first_wins
from postlake.sources.boards import at_board, boards
from postlake.schema import POSTING_COLUMNS

UNTITLED = "Untitled role"


def site_rules(rules: DataFrame, source: str) -> DataFrame:
    """The rule columns a parser needs, for the enabled companies of its source type, by company and board."""
    enabled = rules.where(F.coalesce("enabled", F.lit(True)) & (F.col("source_type") == source))
    return boards(
        enabled,
        "ats_identifier",
        "careers_url",
        "api_endpoint",
        F.coalesce(F.lower(F.col("extra")["fetch_details"]) != "false", F.lit(True)).alias("fetch_details"),
        F.col("extra")["domain"].alias("domain"),
    ).drop("source_type")


def list_pages(captures: DataFrame, rules: DataFrame, source: str, *fields: Column) -> DataFrame:
    """Parsed fields of the list pages of one source, joined to their site's settings.

    Fields are extracted before the join, so page bodies are not shuffled.
    """
    pages = captures.where((F.col("source_type") == source) & (F.col("kind") == "list"))
    parsed = pages.select("run_id", "company", "board", "page_no", "fetched_at", "url", *fields)
    return at_board(parsed, site_rules(rules, source), "company")


def details(captures: DataFrame, rules: DataFrame, source: str, *fields: Column) -> DataFrame:
    """Parsed fields of the detail pages, one row per run, site and key.

    Fields are extracted before the exchange, so page bodies are not shuffled.
    """
    pages = captures.where((F.col("source_type") == source) & (F.col("kind") == "detail"))
    parsed = pages.select("run_id", "company", "board", "detail_key", "fetched_at", *fields)
    site = site_rules(rules, source).select("company", "_board", "company_ord")
    placed = at_board(parsed, site, "company")
    return first_wins(placed, ["run_id", "company", "company_ord", "detail_key"], ["fetched_at"]).drop("fetched_at")


def explode_objects(pages: DataFrame, values: str, name: str = "v") -> DataFrame:
    """One row per object element with its position; other elements are dropped."""
    keep = [F.col(c) for c in pages.columns if c != values]
    return exploded(pages, values, name, *keep).where(V.is_object(name))


def exploded(pages: DataFrame, values: str, name: str, *keep: Column | str) -> DataFrame:
    """One row per element with its position.

    Pages without elements are dropped after the explode: for a plain one Spark adds a filter on the array's size below
    it, which parses every page again.
    """
    return pages.select(*keep, F.posexplode_outer(values).alias("pos", name)).where("pos is not null")


def postings(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    """Select the posting columns; `fields` are those that are not columns of `df` already."""
    fields.setdefault("source", F.lit(source))
    fields.setdefault("stable_job_id", fields.get("source_job_id", F.col("source_job_id")))
    chosen = []
    for name in POSTING_COLUMNS:
        chosen.append(fields[name].alias(name) if name in fields else F.col(name))
    return df.select(*chosen)
