"""Which site a capture belongs to: company, source type and board, not the company's name alone.

One company may have several boards of one source type. A capture's `board` is its rule's identifier, endpoint or
careers page, whichever the rule has first; a capture without one belongs to the company's first site of its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import nonempty


def boards(rules: DataFrame, *columns: Column | str) -> DataFrame:
    """(company, source_type, _board, company_ord, columns): one row for each board, and one for captures without."""
    named = F.coalesce(nonempty("ats_identifier"), nonempty("api_endpoint"), nonempty("careers_url"), F.lit(""))
    sites = rules.select("company", "source_type", "company_ord", named.alias("_own"), *columns)
    first = F.min("company_ord").over(Window.partitionBy("company", "source_type")) == F.col("company_ord")
    both = F.when(F.col("_first"), F.array_distinct(F.array("_own", F.lit("")))).otherwise(F.array("_own"))
    spread = sites.withColumn("_first", first).withColumn("_board", F.explode(both)).drop("_first")
    # Two rules of one board are one site.
    rank = F.row_number().over(Window.partitionBy("company", "source_type", "_board").orderBy(F.col("_own") != F.col("_board"), "company_ord"))
    return spread.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_own")


def at_board(captures: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """Captures with the columns of their site; those of no configured site go."""
    board = F.coalesce(nonempty("board"), F.lit(""))
    return captures.withColumn("_board", board).join(sites, [*keys, "_board"]).drop("_board", "board")
