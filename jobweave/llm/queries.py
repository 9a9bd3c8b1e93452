"""One query per operator over the table of documents, with production parameters, and the SQL of those that have one."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import chat, fim, fingerprint, language, licenses, mixing, neardup, packing, pii, quality, suffix, tokens, vectors
from jobweave.llm.text import documents
from jobweave.session import configure, use_local_folder

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(use_local_folder(spark)), sf_dir)

    LLM_QUERIES[fn.__name__] = run
    return fn


def vocabulary() -> str:
    """The vocabulary file of the packing and counting queries."""
    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary())


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


@_query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint.fingerprints(documents(spark, sf_dir))


@_query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.predict_language(documents(spark, sf_dir))


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan_licenses(documents(spark, sf_dir))


LLM_ORACLE["op5_license_scan"] = licenses.oracle()


@_query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return neardup.near_duplicates(documents(spark, sf_dir))


LLM_ORACLE["op6_near_duplicates"] = neardup.ORACLE


@_query
def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 200 bytes cover which start more than once."""
    return suffix.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


@_query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_sources(documents(spark, sf_dir))


LLM_ORACLE["op8_source_mix"] = mixing.ORACLE


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), vocabulary()).drop("text")


@_query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", *(pii.number(F.col("base_spans"), k).alias(f"n_{k}") for k in pii.PATTERNS),
        F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.col("all_spans")).alias("spans"))


@_query
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one whose texts look like marks, read back from the formatted text."""
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.TRAP).alias("text"))
    return chat.chat_report(turns.unionByName(trap))


LLM_ORACLE["op11_chat_formatting"] = chat.ORACLE


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every document, and of its text rebuilt from the output."""
    cut = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


LLM_ORACLE["op12_fill_in_middle"] = fim.ORACLE


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return vectors.code_report(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


LLM_ORACLE["op13_vector_codes"] = vectors.oracle()
