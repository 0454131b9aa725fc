"""The whole run as a function of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import strip
from postlake.operators.dedup import (
    fail_whole_companies,
    new_postings,
    with_dedup_key,
    with_reject_reason,
)
from postlake.operators.report import company_results, failure_message, failure_rows, run_summary
from postlake.operators.rules import (
    GlobalFilters,
    effective_rules,
    evaluate,
    require_company,
    select_companies,
)
from postlake.operators.store import JobStore, to_job_rows, to_run_log
from postlake.session import materialize
from postlake.sources import SourceParser, needed_sources, parse_all, unsupported
from postlake.sources.captures import fetch_failures, unreadable


@dataclass
class Run:
    """Lazy results of one run."""

    postings: DataFrame
    decided: DataFrame
    matched: DataFrame
    new_jobs: DataFrame
    rejects: DataFrame
    failures: DataFrame
    results: DataFrame
    summary: DataFrame


def decide(postings: DataFrame, companies: DataFrame, filters: GlobalFilters) -> DataFrame:
    """Keys and decisions for valid postings."""
    return with_dedup_key(evaluate(postings, effective_rules(companies, filters), keep_norms=True))


def run(
    captures: DataFrame,
    rules: DataFrame,
    filters: GlobalFilters | None = None,
    seen: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    *,
    company: str | None = None,
    strict: bool = False,
    sources: Mapping[str, SourceParser] | None = None,
    failed: DataFrame | None = None,
    store_decisions: bool = False,
) -> Run:
    """Parse, decide, deduplicate and count.

    `seen` left out is a dry run against an empty store; a function is given the keys of the matched
    postings and returns the known ones among them, others too if it likes. `strict` drops all postings of a company
    with one invalid posting or failed fetch; by default only the invalid row is rejected and what
    was fetched is kept. `failed` are captures whose fetch failed; they enter the failure list.
    `store_decisions` writes
    the decisions, without descriptions, once to the shared folder, for runs whose results feed
    several actions.
    """
    rules = rules.withColumn("company", strip("company"))
    captures = captures.withColumn("company", strip("company"))
    companies = require_company(rules, company) if company else select_companies(rules)
    # Injected sources are all used; registered ones only where a company has their type.
    parsers = needed_sources(companies) if sources is None else sources
    parsed = parse_all(captures, companies, parsers)
    checked = with_reject_reason(parsed)
    outcome = decide(checked, companies, filters or GlobalFilters())
    if store_decisions:
        # Decisions and rejects from one pass over the captures; no output column needs the long text any more.
        outcome = materialize(outcome.drop("description"), "decisions")
    rejects = outcome.where("reject_reason <> ''")
    decided = outcome.where("reject_reason = ''").drop("reject_reason")
    valid = checked.where("reject_reason = ''").drop("reject_reason")
    failures = unsupported(companies, sources).unionByName(unreadable(captures, companies))
    if failed is not None:
        failed = failed.withColumn("company", strip("company"))
        unfetched = fetch_failures(failed, companies)
        failures = failures.unionByName(unfetched.select("company", "company_ord", "message"))
        if strict:
            missed = unfetched.select("run_id", "company")
            valid, decided = (x.join(missed, ["run_id", "company"], "left_anti") for x in (valid, decided))
    if strict:
        valid, decided = (fail_whole_companies(x, rejects) for x in (valid, decided))
    # Rejected postings are reported by company and reason, whether or not they fail the company.
    rejected = rejects.groupBy("company", "company_ord", "reject_reason").count()
    counted = F.concat("reject_reason", F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
    failures = failures.unionByName(
        rejected.select(
            "company",
            "company_ord",
            failure_message("company", "ValidationError", counted).alias("message"),
        )
    )
    if store_decisions:
        failures = materialize(failures, "failures")
    matched = decided.where(F.col("match_status") == "matched")
    empty = decided.sparkSession.createDataFrame([], "dedup_key string")
    if callable(seen):
        seen = seen(matched.select("dedup_key").distinct())
    known = empty if seen is None else seen
    results = company_results(companies, decided, seen, failures)
    return Run(
        postings=valid,
        decided=decided,
        matched=matched,
        new_jobs=new_postings(matched, known),
        rejects=rejects,
        failures=failures,
        results=results,
        summary=run_summary(results),
    )


def run_into(
    store: JobStore,
    captures: DataFrame,
    rules: DataFrame,
    filters: GlobalFilters | None = None,
    *,
    batch: str,
    dry_run: bool = False,
    company: str | None = None,
    strict: bool = False,
    sources: Mapping[str, SourceParser] | None = None,
    failed: DataFrame | None = None,
    also: Callable[[dict], None] | None = None,
) -> Run:
    """Run against a store. New postings, failures and the run log appear in one version of it.

    Of the stored keys, only the buckets that can hold a matched posting's key are read. `also` changes
    the store's state in the same version. A dry run reads and writes nothing.
    """
    started = time.monotonic()
    if dry_run:
        return run(
            captures, rules, filters, company=company, strict=strict, sources=sources, failed=failed
        )
    store.ensure_tables()
    done = run(
        captures,
        rules,
        filters,
        lambda keys: store.seen_among(keys, excluding_batch=batch),
        company=company,
        strict=strict,
        sources=sources,
        failed=failed,
        store_decisions=True,
    )
    log = to_run_log(done.summary, F.current_timestamp(), F.lit(float(time.monotonic() - started)))
    tables = {"jobs": to_job_rows(done.new_jobs), "failures": failure_rows(done.failures), "run_log": log}
    store.put(batch, tables, also)
    return done
