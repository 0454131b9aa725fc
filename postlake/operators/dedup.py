"""Deduplication keys, new postings and the seen-key set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import (
    location_from_norm,
    nonempty,
    norm_text,
    strip,
    title_from_norm,
)
from postlake.functions.urls import norm_url, short_hash
from postlake.operators.assemble import first_wins

RUN_ORDER = ["run_id", "company_ord", "page_no", "pos"]


def with_dedup_key(postings: DataFrame) -> DataFrame:
    """Add `dedup_key`: by source id, else by URL, else by company, title and location.

    Normal forms that `evaluate` left in `n_company`, `n_title` and `n_location` are used and dropped.
    """

    def norm(name: str) -> Column:
        ready = f"n_{name}"
        return F.col(ready) if ready in postings.columns else norm_text(name)

    staged = postings.withColumns(
        {
            "_company": norm("company"),
            "_id": norm_text("source_job_id"),
            "_title": norm("title"),
            "_location": norm("location"),
            "_url": F.coalesce(nonempty("application_url"), nonempty("posting_url")),
        }
    )
    by_id = F.concat(F.lit("source:"), F.col("_company"), F.lit(":"), F.col("_id"))
    by_url = F.concat(F.lit("url:"), short_hash(norm_url("_url")))
    by_text = F.concat(
        F.lit("fallback:"),
        F.col("_company"),
        F.lit(":"),
        title_from_norm("_title"),
        F.lit(":"),
        location_from_norm("_location"),
    )
    key = (
        F.when(nonempty("source_job_id").isNotNull(), by_id)
        .when(F.col("_url").isNotNull(), by_url)
        .otherwise(by_text)
    )
    return staged.withColumn("dedup_key", key).drop(
        "_company", "_id", "_title", "_location", "_url", "n_company", "n_title", "n_location"
    )


def with_reject_reason(postings: DataFrame) -> DataFrame:
    """Company, title and source stripped, and `reject_reason`: which of them are missing, else empty."""
    names = ["company", "title", "source"]
    stripped = postings.withColumns({n: F.coalesce(strip(n), F.lit("")) for n in names})
    reason = F.concat_ws(
        ", ", *[F.when(F.col(n) == "", F.lit(f"{n} cannot be empty")) for n in names]
    )
    return stripped.withColumn("reject_reason", reason)


def split_valid(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with company, title and source, stripped, and the rejected rest with a reason."""
    checked = with_reject_reason(postings)
    return checked.where("reject_reason = ''").drop("reject_reason"), checked.where("reject_reason <> ''")


def fail_whole_companies(valid: DataFrame, rejects: DataFrame) -> DataFrame:
    """Strict mode: a company with any rejected row contributes nothing to that run."""
    failed = rejects.select("run_id", "company").distinct()
    return valid.join(failed, ["run_id", "company"], "left_anti")


def first_in_run(matched: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """First posting per key in company order, then page and position."""
    return first_wins(matched, ["dedup_key"], order or RUN_ORDER)


def unseen(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose key is not in the seen set."""
    return postings.join(seen.select("dedup_key"), "dedup_key", "left_anti")


def already_seen(postings: DataFrame, seen: DataFrame) -> DataFrame:
    return postings.join(seen.select("dedup_key"), "dedup_key", "left_semi")


def new_postings(
    matched: DataFrame, seen: DataFrame, order: list[str | Column] | None = None
) -> DataFrame:
    """First-wins, then the anti join: the exchange on the key serves both."""
    return unseen(first_in_run(matched, order), seen)


def union_seen(*parts: DataFrame) -> DataFrame:
    """Distinct keys of several key sets."""
    keys = [p.select("dedup_key").where("dedup_key is not null and dedup_key <> ''") for p in parts]
    out = keys[0]
    for part in keys[1:]:
        out = out.unionByName(part)
    return out.distinct()


def sightings(postings: DataFrame, at: str = "fetched_at") -> DataFrame:
    """First and last time every key was seen, and how often."""
    return postings.groupBy("dedup_key").agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_seen")
    )


def merge_sightings(parts: DataFrame) -> DataFrame:
    """Sightings of one key from several tables as one row."""
    return parts.groupBy("dedup_key").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_seen").alias("n_seen")
    )
