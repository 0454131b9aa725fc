"""Documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import bpe, minhash, mixing, quality, runindex
from postlake.llm.common import table
from postlake.llm.queries import DOMAIN_WEIGHTS, tokenizer_path
from postlake.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts stay."""
    return quality.filtered(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id.

    Rows that repeat a kept document go too. Rows without doc_id belong to no group and stay.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80)
    kept = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere. No document goes.

    Whole characters are removed. Null texts become empty.
    """
    cleaned = runindex.without_repeats(docs, whole_characters=True).withColumn("text", F.col("kept").cast("string"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that the domains' tokens meet their targets."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labelled, DOMAIN_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.load(tokenizer_path()))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("repeats", remove_repeats),
    ("mixing", mix),
    ("bpe", encode),
]

#: Trained models and a tokenizer are not to be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
