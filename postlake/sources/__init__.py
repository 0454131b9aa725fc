"""Source parsers and their registry.

A parser turns captures and rules into postings: `(captures, rules) -> DataFrame` with the columns of
`schema.POSTINGS`. `register_source` adds one; companies of other types end up as failures.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.schema import POSTINGS
from postlake.sources.ashby import parse_ashby
from postlake.sources.avature import parse_avature
from postlake.sources.eightfold import parse_eightfold
from postlake.sources.greenhouse import parse_greenhouse
from postlake.sources.icims import parse_icims
from postlake.sources.lever import parse_lever
from postlake.sources.smartrecruiters import parse_smartrecruiters
from postlake.sources.successfactors import parse_successfactors
from postlake.sources.workday import parse_workday

SourceParser = Callable[[DataFrame, DataFrame], DataFrame]

# `custom` is a declared type without a parser.
CUSTOM = "custom"

# Types whose list rows are completed by detail pages.
DETAIL_SOURCES = ["smartrecruiters", "eightfold", "icims", "avature", "successfactors"]

_REGISTRY: dict[str, SourceParser] = {
    "greenhouse": parse_greenhouse,
    "lever": parse_lever,
    "ashby": parse_ashby,
    "workday": parse_workday,
    "smartrecruiters": parse_smartrecruiters,
    "eightfold": parse_eightfold,
    "icims": parse_icims,
    "avature": parse_avature,
    "successfactors": parse_successfactors,
}


def registered_sources() -> dict[str, SourceParser]:
    return dict(_REGISTRY)


def register_source(name: str, parser: SourceParser) -> None:
    _REGISTRY[name] = parser


def needed_sources(
    rules: DataFrame, sources: Mapping[str, SourceParser] | None = None
) -> dict[str, SourceParser]:
    """The parsers some company asks for; at most one name per source type reaches the driver."""
    known = registered_sources() if sources is None else sources
    asked = rules.select("source_type").where(F.col("source_type").isin(list(known))).distinct()
    wanted = {row.source_type for row in asked.collect()}
    return {name: parser for name, parser in known.items() if name in wanted}


def parse_all(
    captures: DataFrame, rules: DataFrame, sources: Mapping[str, SourceParser] | None = None
) -> DataFrame:
    """Postings of every source type, concatenated.

    Each branch filters on `source_type`; captures partitioned by it are read once in all.
    """
    parsers = registered_sources() if sources is None else sources
    if not parsers:
        return captures.sparkSession.createDataFrame([], POSTINGS)
    return reduce(
        DataFrame.unionByName, [parser(captures, rules) for parser in parsers.values()]
    )


def unsupported(rules: DataFrame, sources: Mapping[str, SourceParser] | None = None) -> DataFrame:
    """Failures of enabled companies whose source type has no parser."""
    known = list(registered_sources() if sources is None else sources)
    enabled = rules.where(F.coalesce("enabled", F.lit(True)))
    return enabled.where(~F.col("source_type").isin(known)).select(
        "company",
        "company_ord",
        F.concat(
            "company",
            F.lit(": NotImplementedError: "),
            "source_type",
            F.lit(" is not supported"),
        ).alias("message"),
    )
