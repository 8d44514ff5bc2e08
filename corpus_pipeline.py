"""From documents to packed sequences: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import near_copies, op3_mixing, op4_packing, op5_pii, op9_simhash, op10_language
from thicket.llm.common import small_batches, spare, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or without a letter) go; a null lang becomes the predicted one. Learned from the labels of docs."""
    small_batches(spark)
    samples = op10_language.learn(docs)
    named = tuple(spare(docs.columns, "_lang", "_score"))
    out = op10_language.identify(docs, samples, docs.columns, names=named)
    return out.where(F.col(named[0]) != op10_language.UNKNOWN).withColumn("lang", F.coalesce("lang", named[0])).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar to 0.8 or more, directly or over others, the one with the smallest doc_id stays."""
    small_batches(spark)
    return op9_simhash.keep_one(docs, near=near_copies.near_classes)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms, and n_chars follows where a text changed."""
    small_batches(spark)
    spans = spare(docs.columns, "_found")[0]
    out = op5_pii.pseudonymise(docs, docs.columns, op5_pii.session_key(spark), spans=spans)
    return out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return op3_mixing.repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    small_batches(spark)
    return op4_packing.pack(docs, public_tokenizers.path(f"{op4_packing.VOCABULARY}.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: fingerprints, pseudonyms and token ids are not SQL; tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
