"""Company rules and the decision ladder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.sqltext import bind, each_sql, keep_sql, let_sql, q
from postlake.functions.text import WHITESPACE, nonempty, norm_sql, norm_text, strip_sql
from postlake.schema import RULES

# The default keyword lists of the global filters.
DEFAULT_TITLE_KEYWORDS = [
    "data scientist",
    "applied scientist",
    "research scientist",
    "machine learning",
    "ml engineer",
    "ai engineer",
    "ai research",
    "software engineer",
    "llm",
    "large language model",
    "generative ai",
    "agent",
    "retrieval",
    "ranking",
    "recommendation",
    "experimentation",
    "causal inference",
    "forecasting",
]
DEFAULT_DESCRIPTION_KEYWORDS = [
    "machine learning",
    "artificial intelligence",
    "generative ai",
    "large language models",
    "llm",
    "agents",
    "model evaluation",
    "retrieval",
    "recommendation systems",
    "experimentation",
    "causal inference",
    "forecasting",
    "ml infrastructure",
]
DEFAULT_EXCLUDED_KEYWORDS = [
    "intern",
    "internship",
    "sales",
    "recruiter",
    "recruiting",
    "nursing",
    "warehouse",
    "technician",
    "customer support",
    "marketing",
]
DEFAULT_LOCATIONS = [
    "united states",
    "usa",
    "us",
    "remote",
    "hybrid",
    "california",
    "new york",
    "washington",
    "texas",
    "massachusetts",
]
DEFAULT_SENIORITY = ["director", "vp", "vice president", "executive"]

# Locations too broad to accept a posting on their own.
BROAD_LOCATIONS = [
    "united states",
    "usa",
    "us",
    "u s",
    "u s a",
    "remote",
    "hybrid",
    "california",
    "ca",
    "new york",
    "ny",
    "washington",
    "wa",
    "texas",
    "tx",
    "massachusetts",
    "ma",
]
INTERNSHIP_WORDS = ["intern", "internship"]

# Source types, and the one that needs no locator.
SOURCE_TYPES = [
    "greenhouse",
    "lever",
    "ashby",
    "workday",
    "smartrecruiters",
    "eightfold",
    "icims",
    "avature",
    "successfactors",
    "custom",
]
NO_LOCATOR_NEEDED = "custom"


@dataclass(frozen=True)
class GlobalFilters:
    """Filters that hold for every company without lists of its own."""

    title_keywords: list[str] = field(default_factory=lambda: list(DEFAULT_TITLE_KEYWORDS))
    description_keywords: list[str] = field(
        default_factory=lambda: list(DEFAULT_DESCRIPTION_KEYWORDS)
    )
    exclude_keywords: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDED_KEYWORDS))
    locations: list[str] = field(default_factory=lambda: list(DEFAULT_LOCATIONS))
    employment_types: list[str] = field(default_factory=list)
    seniority_exclude: list[str] = field(default_factory=lambda: list(DEFAULT_SENIORITY))
    allow_internships: bool = False


def _clean_sql(x: str) -> str:
    stripped = each_sql(f"coalesce({x}, cast(array() as array<string>))", strip_sql)
    return keep_sql(stripped, lambda k: f"{k} is not null and {k} <> ''")


def clean_list(c: Column | str) -> Column:
    """Entries stripped, blank ones dropped; a missing list is empty."""
    return bind(c, _clean_sql)


def _literal(values: list[str]) -> str:
    """A configured list as an array constant, cleaned like the company lists."""
    kept = ", ".join(q(v.strip()) for v in values if v and v.strip())
    return f"cast(array({kept}) as array<string>)"


def _norms_sql(values: str) -> str:
    return each_sql(values, lambda k: f"named_struct('raw', {k}, 'norm', {norm_sql(k)})")


def with_norms(values: Column | str) -> Column:
    """ARRAY<STRUCT<raw, norm>>: keywords are normalised once per company, not once per posting."""
    return bind(values, _norms_sql)


def effective_rules(companies: DataFrame, filters: GlobalFilters) -> DataFrame:
    """One row per company with the keyword lists that apply to it."""

    def own_or_global(own: str, fallback: list[str]) -> Column:
        chosen = let_sql(
            _clean_sql(own), lambda c: f"if(size({c}) > 0, {c}, {_literal(fallback)})"
        )
        return F.expr(_norms_sql(chosen))

    excludes = f"concat({_literal(filters.exclude_keywords)}, {_clean_sql('title_keywords_exclude')})"
    excluding = _norms_sql(excludes)
    if filters.allow_internships:
        words = ", ".join(q(w) for w in INTERNSHIP_WORDS)
        excluding = keep_sql(excluding, lambda k: f"{k}.norm not in ({words})")
    staged = companies.select(
        "company",
        "company_ord",
        norm_text("company").alias("n_company"),
        own_or_global("title_keywords_include", filters.title_keywords).alias("title_kw"),
        own_or_global("description_keywords_include", filters.description_keywords).alias(
            "description_kw"
        ),
        F.expr(excluding).alias("exclude_kw"),
        F.expr(_norms_sql(_literal(filters.seniority_exclude))).alias("seniority_kw"),
        own_or_global("location_filters", filters.locations).alias("location_kw"),
        own_or_global("employment_types", filters.employment_types).alias("employment_kw"),
    )
    broad = ", ".join(q(w) for w in BROAD_LOCATIONS)
    specific = keep_sql("location_kw", lambda k: f"{k}.norm not in ({broad})")
    return staged.withColumn("specific_location_kw", F.expr(specific))


def contains_any(norm: str, keywords: str) -> Column:
    """Original keywords whose normal form occurs in the text, in list order.

    Both arguments name columns. A keyword without letters or digits has an empty normal form and
    occurs everywhere. The text is bound outside the filter: an expression that Spark puts in the name's place is
    evaluated once per row, not once per keyword.
    """
    return F.expr(let_sql(norm, lambda n: f"transform(filter({keywords}, k -> contains({n}, k.norm)), k -> k.raw)"))


def job_text(*norms: Column | str) -> Column:
    """Normal form of title, description, department, location and employment type joined.

    Joining the normal forms equals normalising the joined text, so every field is normalised once.
    """
    return F.concat_ws(" ", *[nonempty(c) for c in norms])


NORMS = ["n_title", "n_description", "n_department", "n_location", "n_employment"]


def normalise_fields(postings: DataFrame) -> DataFrame:
    """Normal forms the ladder reads."""
    return postings.withColumns(
        {
            "n_title": norm_text("title"),
            "n_description": norm_text("description"),
            "n_department": norm_text("department"),
            "n_location": norm_text("location"),
            "n_employment": norm_text("employment_type"),
        }
    )


# Reason classes in ladder order.
EXCLUDED, SENIORITY, LOCATION, EMPLOYMENT, NO_KEYWORDS, MATCHED = (
    "excluded",
    "seniority",
    "location",
    "employment",
    "no_keywords",
    "matched",
)


_KEYWORDS = "array_distinct(concat(title_hits, description_hits))"
_LADDER = f"""
  case when size(exclude_hits) > 0 then '{EXCLUDED}'
       when size(seniority_hits) > 0 then '{SENIORITY}'
       when size(location_kw) > 0 and size(location_hits) = 0 then '{LOCATION}'
       when size(employment_kw) > 0 and employment_type <> '' and size(employment_hits) = 0 then '{EMPLOYMENT}'
       when size({_KEYWORDS}) = 0 then '{NO_KEYWORDS}'
       else '{MATCHED}' end"""

# The reason texts.
_REASON = f"""
  case reason_class
    when '{EXCLUDED}' then concat('excluded keyword(s): ', array_join(exclude_hits, ', '))
    when '{SENIORITY}' then concat('excluded seniority: ', array_join(seniority_hits, ', '))
    when '{LOCATION}' then concat('location did not match configured filters: ', coalesce(location, ''))
    when '{EMPLOYMENT}' then concat('employment type did not match: ', employment_type)
    when '{NO_KEYWORDS}' then 'no configured title or description keywords matched'
    else concat_ws('; ',
      if(size(title_hits) > 0, concat('title matched: ', array_join(title_hits, ', ')), null),
      if(size(description_hits) > 0, concat('description matched: ', array_join(description_hits, ', ')), null),
      if(size(location_hits) > 0, concat('location matched: ', array_join(location_hits, ', ')), null))
  end"""


def evaluate(postings: DataFrame, rules: DataFrame, keep_norms: bool = False) -> DataFrame:
    """Join the effective rules and stamp match status, keywords, reason and reason class.

    With `keep_norms` the normal forms that the deduplication key needs stay for `with_dedup_key`.
    The join carries no hint: a small rule table is broadcast by its size, a large one is shuffled
    and a company that holds much of the data is split by adaptive execution. Texts are normalised
    after it, so that only the texts are shuffled, and handed on as a generated row: a filter on the decisions stays
    above it, where in a plain projection it would take a copy of a normal form for each of its uses.
    """
    both = postings.join(rules, ["company", "company_ord"])
    normed = normalise_fields(both).select(*both.columns, F.explode_outer(F.array(F.struct(*NORMS))).alias("_n"))
    joined = normed.select(*both.columns, "_n.*")
    whole = job_text("n_title", "n_description", "n_department", "n_location", "n_employment")
    hits = joined.withColumn("n_all", whole).withColumns(
        {
            "title_hits": contains_any("n_title", "title_kw"),
            "description_hits": contains_any("n_description", "description_kw"),
            "exclude_hits": contains_any("n_all", "exclude_kw"),
            "seniority_hits": contains_any("n_title", "seniority_kw"),
            "location_hits": contains_any("n_location", "specific_location_kw"),
            "employment_hits": contains_any("n_employment", "employment_kw"),
        }
    )
    staged = hits.withColumns({"reason_class": F.expr(_LADDER), "keywords": F.expr(_KEYWORDS)})
    decided = staged.withColumns(
        {
            "match_status": F.expr("if(reason_class = 'matched', 'matched', 'filtered_out')"),
            "matched_keywords": F.expr(
                "if(reason_class = 'matched', keywords, cast(array() as array<string>))"
            ),
            "match_reason": F.expr(_REASON),
        }
    )
    norms = ["n_company", "n_title", "n_location"] if keep_norms else []
    return decided.select(
        *postings.columns, "match_status", "matched_keywords", "match_reason", "reason_class", *norms
    )


def company_key(slug: Column | str, name: Column | str) -> Column:
    """Slug, else the lower-case name with hyphens for spaces."""
    return F.coalesce(nonempty(slug), F.replace(F.lower(name), F.lit(" "), F.lit("-")))


def select_companies(rules: DataFrame, key: str | None = None) -> DataFrame:
    """Enabled companies, optionally only the one with this key or name."""
    enabled = rules.where(F.coalesce("enabled", F.lit(True)))
    if not key:
        return enabled
    wanted = key.casefold()
    return enabled.where(
        (F.lower(company_key("slug", "company")) == wanted) | (F.lower("company") == wanted)
    )


def require_company(rules: DataFrame, key: str) -> DataFrame:
    """`select_companies`, failing when no company fits."""
    chosen = select_companies(rules, key)
    if chosen.limit(1).count() == 0:
        raise ValueError(f"no enabled company matched: {key}")
    return chosen


def check_rules(rules: DataFrame) -> DataFrame:
    """One row per breach of the configuration constraints."""
    missing = F.lit(None).cast("string")
    blank = F.coalesce(F.regexp_replace("company", f"[{WHITESPACE}]+", ""), F.lit("")) == ""
    unknown = ~F.coalesce(F.col("source_type").isin(SOURCE_TYPES), F.lit(False))
    locator = F.coalesce(nonempty("api_endpoint"), nonempty("ats_identifier"), nonempty("careers_url"))
    homeless = locator.isNull() & ~unknown & (F.col("source_type") != NO_LOCATOR_NEEDED)
    breaches = F.array(
        F.when(blank, F.lit("company name is required")).otherwise(missing),
        F.when(unknown, F.lit("unknown source type")).otherwise(missing),
        F.when(homeless, F.lit("a locator is required")).otherwise(missing),
    )
    found = rules.select(
        "company_ord", "company", F.explode(F.array_compact(breaches)).alias("breach")
    )
    none_configured = (
        rules.agg(F.count(F.lit(1)).alias("n"))
        .where("n = 0")
        .select(
            F.lit(None).cast(RULES["company_ord"].dataType).alias("company_ord"),
            F.lit(None).cast("string").alias("company"),
            F.lit("at least one company must be configured").alias("breach"),
        )
    )
    return found.unionByName(none_configured)
