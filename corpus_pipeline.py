"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet to the shared folder and reads again as the next stage's docs. All but
the last return the columns of documents, and any further ones. A stage decides on
rows by doc_id and whole text together, so rows that share a doc_id, or have none,
stay or go by their own texts. Null texts are empty; an empty table passes through
every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritext.llm import common, decontamination, exact_dedup, jaccard_join, quality_classifier, sentencepiece_bpe

#: Near duplicates: words in a shingle, and the similarity from which on documents link.
SHINGLE, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return jaccard_join.keep_one(docs, SHINGLE, NUM, DEN)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of what is left."""
    return sentencepiece_bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("decontamination", decontaminate),
    ("sentencepiece", tokens),
]

#: The quality classifier is trained and the tokenizer's merges are no SQL, so no stage after the first can be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with common.scratch(spark) as keep:
            before, docs = docs, common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
        common.drop(before)
    return docs
