"""The corpus pipeline: documents that are not toxic, without copies and near copies, with personal data masked, packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next one. All but the last keep the columns of documents.

Odd rows: a null text counts as empty and stays null; empty texts are equal to each other, so one of them stays. Rows with a null id are never dropped as copies, since nothing says which row a drop would mean. Rows that repeat an id and a text stay or go together. Extra columns, whatever their names, stay as they are until the last stage. An empty table gives no rows in any stage; without labelled documents nothing is known to be toxic, and all stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import dedup, jaccard, packing, pii, toxicity
from logloom.llm.common import table, written

TOXIC = 0.3


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under TOXIC, by a model of the labelled documents at hand; without any, all documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, TOXIC) if model.learnt else docs


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the least id."""
    return dedup.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id."""
    return jaccard.one_of_each(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, where there is such a column, is that of the new text."""
    clean = pii.masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("pii", pii_masking),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs


#: A learnt model, a search for near copies and a tokenizer have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None
