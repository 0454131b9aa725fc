"""Landed captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import xml as X
from postlake.schema import CAPTURES
from postlake.sources.boards import at_board, boards


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captures from a folder of Parquet, JSON lines or ORC files.

    Partitioned by `source_type` and `kind`, each parser branch reads its own folders only. Failed
    fetches are left out.
    """
    landed = spark.read.format(fmt).schema(CAPTURES).load(path)
    return landed.where(F.col("status").isNull() | F.col("status").between(200, 299))


def failed_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captures whose fetch ended with an error status."""
    landed = spark.read.format(fmt).schema(CAPTURES).load(path)
    return landed.where(~F.col("status").between(200, 299))


def fetch_failures(failed: DataFrame, rules: DataFrame) -> DataFrame:
    """One failure text per company and run: that of its first failed page."""
    message = F.concat(
        "company", F.lit(": HTTPStatusError: "), F.col("status").cast("string"), F.lit(" for "), "url"
    )
    known = at_board(failed, boards(rules), "company", "source_type")
    return known.groupBy("run_id", "company", "company_ord").agg(
        F.min_by(message, F.struct(F.col("kind") != "list", "page_no", "url")).alias("message")
    )


#: Source types whose documents are JSON.
JSON_SOURCES = ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "eightfold"]
#: The source type whose lists may be XML feeds.
XML_SOURCE = "successfactors"


def unreadable(captures: DataFrame, rules: DataFrame) -> DataFrame:
    """One failure text per site whose JSON or XML documents cannot be read, with their number."""
    where = ["company", "source_type", "board", "kind", "page_no", "url"]
    json_docs = captures.where(F.col("source_type").isin(JSON_SOURCES) & F.try_parse_json("body").isNull())
    feeds = captures.where((F.col("source_type") == XML_SOURCE) & (F.col("kind") == "list") & X.is_xml("body"))
    feeds = feeds.select(*where, X.xml_feed("body")["error"].alias("error")).where("error is not null").drop("error")
    broken = json_docs.select(*where, F.lit("JSONDecodeError").alias("error")).unionByName(
        feeds.withColumn("error", F.lit("ParseError"))
    )
    known = at_board(broken, boards(rules), "company", "source_type")
    first = F.min_by(F.coalesce("url", F.lit("")), F.struct(F.col("kind") != "list", "page_no", "url"))
    return known.groupBy("company", "company_ord", "error").agg(
        F.concat(
            F.first("company"), F.lit(": "), F.first("error"), F.lit(": "), F.count(F.lit(1)).cast("string"),
            F.lit(" unreadable, first "), first,
        ).alias("message")
    ).drop("error")


def write_captures(captures: DataFrame, path: str) -> None:
    captures.write.mode("append").partitionBy("source_type", "kind").parquet(path)
