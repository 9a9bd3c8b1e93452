"""Documents to packed sequences: quality rules, near duplicates, personal data, mix of sources, packing."""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import mixing, neardup, packing, pii, quality
from jobweave.llm.queries import vocabulary
from jobweave.llm.text import documents
from jobweave.session import configure, discard, use_local_folder, written


# The columns that stages read; any other is carried along under a name that no operator uses.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage):
    """A stage whose other columns, whatever their names, come out as they went in."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = docs.toDF(*(c if c in COLUMNS else f"own {i}" for i, c in enumerate(docs.columns)))
        return stage(spark, own, sf_dir).toDF(*docs.columns)
    return run


@_carrying
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep.

    Null and empty texts have no words and go; very long texts count whole; of repeated rows all stay or go, as their counts
    are equal; rows without an id are judged like others, but are no part of the labelled sample; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels).where("kept").select(docs.columns)


@_carrying
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and empty texts have no shingles and stay; very long texts count whole; repeated rows and different texts under one
    kept id all stay, and so do all rows without an id, copies included; an empty table stays empty.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


@_carrying
def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that disclose it, generalised to tags; n_chars follows.

    Every row comes out once. A null text stays null and an empty one empty; repeated rows get equal texts; rows without an id
    are treated like others; an empty table stays empty.
    """
    found = pii.find_personal_data(docs).withColumn("text", pii.sanitise(F.col("text"), F.col("all_spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_carrying
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, rounded to whole copies.

    Null and empty texts have no words and go; rows of equal id and source share their fate, repeated rows each; a null
    source is one source; a document may come out several times; an empty table stays empty.
    """
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = (mixing.mix_sources(docs).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), copies.alias("_copies"))
             .where("_copies > 0").dropDuplicates(["_id", "_source"]))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_id"]) & docs["source"].eqNullSafe(taken["_source"]))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Null and empty texts are one token each; repeated rows are packed each; a null id stays null; other columns are left
    out; an empty table gives none.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("source mix", mix_stage),
    ("packing", packing_stage),
]

# A forest, token ids and a curve are no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of a folder; each stage's rows are a table in the shared folder."""
    docs = documents(configure(use_local_folder(spark)), sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


pipeline = run
