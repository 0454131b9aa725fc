"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import bpe, chat, langid, merkle, minhash, mixing, periodic, quality, runindex, simhash, spelling, topk, wrappers
from postlake.llm.common import table
from postlake.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    """The public vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Domains of the labels table, and what their expected tokens are multiplied with.
DOMAIN_WEIGHTS = {"plain": 1.2, "low": 0.5, "toxic": 0.9}


@_query("op1_mix_to_targets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    found = mixing.rates(table(spark, sf_dir, "documents"), labelled, DOMAIN_WEIGHTS)
    shares = [(F.get("p", F.lit(i)) / mixing.GRID).alias(f"p_{d}") for i, d in enumerate(DOMAIN_WEIGHTS)]
    return found.select("doc_id", "tokens", *shares, "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


@_query("op2_exact_top_k", topk.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_parts(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@_query("op3_run_index_dedup", runindex.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runindex.digest(runindex.without_repeats(documents))


@_query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


@_query("op5_merkle_fingerprints", merkle.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


@_query("op6_chat_format", chat.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    stored = conversations.unionByName(chat.check_conversation(conversations))
    return chat.digest(chat.render(chat.fold(chat.events_of(stored))))


@_query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(tokenizer_path())
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.encode(documents, vocabulary), vocabulary)


@_query("op8_html_wrappers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.digest(wrappers.extracted(pages, materialize(wrappers.wrappers(pages), "wrappers")))


@_query("op9_weak_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"))


@_query("op10_minhash_near_duplicates", minhash.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@_query("op11_periodic_runs", periodic.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


@_query("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@_query("op13_simhash_near_duplicates")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
