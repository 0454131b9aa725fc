"""Per-company funnel, run totals and failure lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.dedup import RUN_ORDER
from postlake.operators.rules import MATCHED

COUNTS = ["jobs_fetched", "jobs_matched", "new_jobs_inserted", "duplicates_skipped"]

# Companies with neighbouring numbers whose failure texts are joined at once.
BLOCK = 1024


def failure_message(company: Column | str, kind: str, message: Column | str) -> Column:
    return F.concat(company, F.lit(f": {kind}: "), message)


def company_counts(decided: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Fetched, matched, new and duplicate rows per company, in one pass over the decisions.

    Rows are first counted per company and key, which shrinks hot keys before any exchange; the first
    row in run order owns a key, as it is the one that is stored. Unmatched rows of a company share
    one stand-in key. One exchange on the key serves the owners and the seen keys.
    """
    matched = F.col("match_status") == MATCHED
    stand_in = F.concat(F.lit("\x00"), F.col("company"))
    grouped = (
        decided.select(
            "company", "company_ord", matched.alias("hit"), F.struct(*RUN_ORDER).alias("place"),
            F.when(matched, F.col("dedup_key")).otherwise(stand_in).alias("dedup_key"),
        )
        .groupBy("company", "company_ord", "dedup_key", "hit")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    )
    first = F.min(F.when(F.col("hit"), F.col("place"))).over(Window.partitionBy("dedup_key"))
    ranked = grouped.withColumn("owns", F.col("hit") & (F.col("place") == first))
    if seen is not None:
        known = seen.select("dedup_key").distinct().withColumn("known", F.lit(True))
        ranked = ranked.join(known, "dedup_key", "left").withColumn("owns", F.col("owns") & F.col("known").isNull())
    hit_rows = F.when(F.col("hit"), F.col("n")).otherwise(0)
    fresh = F.col("owns").cast("bigint")
    return ranked.groupBy("company", "company_ord").agg(
        F.sum("n").alias("jobs_fetched"),
        F.sum(hit_rows).alias("jobs_matched"),
        F.sum(fresh).alias("new_jobs_inserted"),
        F.sum(hit_rows - fresh).alias("duplicates_skipped"),
    )


def company_results(
    companies: DataFrame,
    decided: DataFrame,
    seen: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row per selected company, also for those without a single posting."""
    counted = companies.select("company", "company_ord").join(
        company_counts(decided, seen), ["company", "company_ord"], "left"
    )
    filled = counted.select(
        "company", "company_ord", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    )
    none = F.array().cast("array<string>")
    if failures is None:
        return filled.withColumn("failures", none)
    per_company = failures.groupBy("company", "company_ord").agg(
        F.array_sort(F.collect_list("message")).alias("failures")
    )
    return filled.join(per_company, ["company", "company_ord"], "left").withColumn(
        "failures", F.coalesce("failures", none)
    )


def failure_rows(failures: DataFrame) -> DataFrame:
    """All failures of the run, one row each: the rows of the store's failures table."""
    return failures.select("company_ord", "company", "message")


def run_summary(results: DataFrame) -> DataFrame:
    """Totals over the company rows: the number of failures, and their texts in company order, one per line.

    The texts are one cell of the run log. They are joined in blocks of companies first, so that the task that makes
    the cell holds one text per block, not one per failure.
    """
    failed = F.when(F.size("failures") > 0, F.struct("company_ord", "failures"))
    texts = F.flatten(F.transform(F.sort_array(F.collect_list(failed)), lambda r: r["failures"]))
    blocks = results.groupBy(F.expr(f"company_ord div {BLOCK}").alias("block")).agg(
        F.count(F.lit(1)).alias("companies"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum(F.size("failures").cast("bigint")).alias("failures"),
        texts.alias("texts"),
    )
    joined = blocks.withColumn("texts", F.when(F.size("texts") > 0, F.struct("block", F.array_join("texts", "\n").alias("text"))))
    in_order = F.sort_array(F.collect_list("texts"))
    return joined.agg(
        F.coalesce(F.sum("companies"), F.lit(0)).alias("companies_checked"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*COUNTS, "failures"]],
        F.array_join(F.transform(in_order, lambda b: b["text"]), "\n").alias("failure_texts"),
    )


def summary_report(results: DataFrame) -> DataFrame:
    """The company rows in company order, range-partitioned, and the totals as one more row.

    `level` is `company` or `total`; companies_checked is the number of companies that a row stands for.
    """
    counts = [F.col(c) for c in COUNTS]
    rows = results.select(F.lit("company").alias("level"), "company_ord", "company", F.lit(1).cast("bigint").alias("companies_checked"), *counts)
    ordinal, name = F.lit(None).cast("bigint").alias("company_ord"), F.lit(None).cast("string").alias("company")
    total = run_summary(results).select(F.lit("total").alias("level"), ordinal, name, "companies_checked", *counts)
    return rows.unionByName(total).orderBy(F.col("company_ord").asc_nulls_last(), "company")


def company_and_total(results: DataFrame) -> DataFrame:
    """Company rows and the grand total (NULL company) from one rollup."""
    return results.rollup("company").agg(*[F.sum(c).alias(c) for c in COUNTS])


def reason_breakdown(decided: DataFrame) -> DataFrame:
    """How many postings of a company ended at each step of the ladder."""
    return decided.groupBy("company", "reason_class").agg(F.count(F.lit(1)).alias("n"))
