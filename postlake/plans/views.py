"""Posting views over the test tables, in the schema of `schema.POSTINGS`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import html as H
from postlake.functions.urls import url_host
from postlake.operators.rules import GlobalFilters
from postlake.plans.registry import table
from postlake.schema import POSTING_COLUMNS


def _posting(df: DataFrame, extra: list[str], **fields) -> DataFrame:
    types = {"date_posted": "date", "fetched_at": "timestamp", "company_ord": "bigint", "page_no": "int", "pos": "int"}
    chosen = []
    for name in POSTING_COLUMNS:
        value = fields.get(name)
        if value is None:
            value = F.lit(None).cast(types.get(name, "string"))
        chosen.append(value.alias(name))
    return df.select(*extra, *chosen)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a posting: its first line is the title, its source the company."""
    d = table(spark, sf_dir, "documents")
    return _posting(
        d,
        ["doc_id"],
        run_id=F.lit("r1"),
        company=F.col("source"),
        company_ord=F.regexp_extract("source", "([0-9]+)", 1).cast("bigint"),
        page_no=F.lit(0),
        pos=F.col("doc_id").cast("int"),
        title=F.split("text", "\n")[0],
        location=F.col("lang"),
        description=F.col("text"),
        source=F.lit("docs"),
    )


DOCS_SQL = """
  select doc_id, source as company, cast(regexp_extract(source, '([0-9]+)', 1) as bigint) as company_ord,
         string_split(text, chr(10))[1] as title, lang as location, text as description
  from documents"""


def doc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule row per document source, some with lists of their own."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("company")).distinct()
    numbered = sources.withColumn(
        "company_ord", F.regexp_extract("company", "([0-9]+)", 1).cast("bigint")
    )
    third = F.col("company_ord") % 3
    none = F.array().cast("array<string>")
    return numbered.select(
        "company_ord",
        "company",
        F.lit(None).cast("string").alias("slug"),
        F.lit(True).alias("enabled"),
        F.lit("custom").alias("source_type"),
        F.lit(None).cast("string").alias("ats_identifier"),
        F.lit(None).cast("string").alias("careers_url"),
        F.lit(None).cast("string").alias("api_endpoint"),
        F.when(third == 0, F.array(F.lit(" EN "), F.lit("Remote")))
        .when(third == 1, F.array(F.lit("fr"), F.lit(""), F.lit("de")))
        .otherwise(none)
        .alias("location_filters"),
        F.when(third == 1, F.array(F.lit("th"), F.lit("le"))).otherwise(none).alias(
            "title_keywords_include"
        ),
        F.when(third == 2, F.array(F.lit("lorem"))).otherwise(none).alias("title_keywords_exclude"),
        none.alias("description_keywords_include"),
        none.alias("employment_types"),
        F.create_map(F.lit("k"), F.lit("v")).alias("extra"),
    )


DOC_FILTERS = GlobalFilters(
    title_keywords=["the", "la", "der"],
    description_keywords=["hetion", "ieux", "Wh", "ción"],
    exclude_keywords=["viagra", "password", "internship"],
    locations=["en", "ES", "usa"],
    employment_types=[],
    seniority_exclude=["qu", "heit"],
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a posting under its URL."""
    p = table(spark, sf_dir, "pages")
    staged = p.withColumns(
        {
            "host": url_host("url"),
            "title": H.page_title("html"),
            "plain": H.strip_html("html", drop_scripts=True),
            "html_lang": F.regexp_extract("html", '(?i)<html[^>]*lang="([^"]*)"', 1),
        }
    )
    return _posting(
        staged,
        ["page_id"],
        run_id=F.lit("r1"),
        company=F.col("host"),
        company_ord=F.lit(0).cast("bigint"),
        page_no=F.lit(0),
        pos=F.col("page_id").cast("int"),
        title=F.col("title"),
        location=F.col("html_lang"),
        description=F.col("plain"),
        posting_url=F.col("url"),
        source=F.lit("pages"),
    )


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a posting of its supplier."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.concat("n_name", F.lit(", "), "r_name").alias("place")
    )
    sellers = supplier.join(places, supplier.s_nationkey == places.n_nationkey)
    joined = line.join(sellers, line.l_suppkey == sellers.s_suppkey).join(
        part, line.l_partkey == part.p_partkey
    )
    job_id = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return _posting(
        joined,
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
        run_id=F.lit("r1"),
        company=F.col("s_name"),
        company_ord=F.col("l_suppkey"),
        page_no=F.lit(0),
        pos=F.col("l_linenumber"),
        title=F.col("p_name"),
        location=F.col("place"),
        employment_type=F.col("p_type"),
        department=F.col("p_brand"),
        source=F.lit("star"),
        source_job_id=job_id,
        stable_job_id=job_id,
        date_posted=F.to_date("l_shipdate"),
        fetched_at=F.col("l_shipdate").cast("timestamp"),
    )


STAR_SQL = """
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
         s_name as company, s_suppkey as company_ord, p_name as title, p_brand as department,
         p_type as employment_type, n_name || ', ' || r_name as location,
         l_orderkey || '-' || l_linenumber as source_job_id
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
       join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

# An order of line items in which rows that tie are equal in every output column.
STAR_ORDER = ["company_ord", "fetched_at", "l_partkey", "l_linenumber"]


def star_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule row per supplier; lists vary so that every fallback is taken."""
    supplier = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    none = F.array().cast("array<string>")
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("company_ord"),
        F.col("s_name").alias("company"),
        F.when(k % 2 == 0, F.concat(F.lit("sup-"), k.cast("string"))).alias("slug"),
        (k % 10 != 9).alias("enabled"),
        F.lit("custom").alias("source_type"),
        F.when(k % 6 != 5, F.lit("ats")).alias("ats_identifier"),
        F.lit(None).cast("string").alias("careers_url"),
        F.lit(None).cast("string").alias("api_endpoint"),
        F.when(k % 4 == 0, F.array(F.col("n_name")))
        .when(k % 4 == 1, F.array(F.lit("United States"), F.col("n_name"), F.lit("Remote")))
        .when(k % 4 == 3, F.array(F.lit("Remote"), F.lit("CA")))
        .otherwise(none)
        .alias("location_filters"),
        F.when(k % 3 == 0, F.array(F.lit("Widget"), F.lit(" "), F.lit(" Ring ")))
        .otherwise(none)
        .alias("title_keywords_include"),
        F.when(k % 5 == 0, F.array(F.lit("rod"))).otherwise(none).alias("title_keywords_exclude"),
        none.alias("description_keywords_include"),
        F.when(k % 2 == 0, F.array(F.lit("Economy"), F.lit("small"), F.lit("standard")))
        .otherwise(none)
        .alias("employment_types"),
        F.create_map(F.lit("k"), F.lit("v")).alias("extra"),
    )


STAR_FILTERS = GlobalFilters(
    title_keywords=["Blue", "gizmo", "red widget", "anvil", "gizmo"],
    description_keywords=["unused"],
    exclude_keywords=["bolt", "internship"],
    locations=["AMERICA", "Europe", "nation-1"],
    employment_types=[],
    seniority_exclude=["old"],
)

# The effective lists of the two functions above, written out for the check queries.
STAR_RULES_SQL = """
  select s_suppkey as company_ord, s_name as company,
         case s_suppkey % 4 when 0 then [n_name] when 1 then ['United States', n_name, 'Remote']
              when 3 then ['Remote', 'CA'] else ['AMERICA', 'Europe', 'nation-1'] end as locs,
         case s_suppkey % 4 when 0 then [n_name] when 1 then [n_name]
              when 3 then [] else ['AMERICA', 'Europe', 'nation-1'] end as specific,
         case when s_suppkey % 3 = 0 then ['Widget', 'Ring'] else ['Blue', 'gizmo', 'red widget', 'anvil', 'gizmo'] end as titles,
         case when s_suppkey % 5 = 0 then ['bolt', 'internship', 'rod'] else ['bolt', 'internship'] end as excludes,
         case when s_suppkey % 2 = 0 then ['Economy', 'small', 'standard'] else [] end as types
  from supplier join nation on s_nationkey = n_nationkey"""
