"""From raw documents to packed training sequences, as four stages.

Every stage takes what its predecessor kept.  The first three return documents with their columns
unchanged, the last one returns packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm.langid import drop_rejected, train_languages
from shoebox.llm.packing import pack_documents
from shoebox.llm.queries import PACK_END, table, tokenizer_path
from shoebox.llm.simhash import keep_one_per_group
from shoebox.llm.storage import materialize
from shoebox.llm.toxicity import drop_toxic, train_toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those no learnt language fits, go."""
    return drop_rejected(docs, train_languages(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.3 go; labels come from the ``labels`` table."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one_per_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become power-of-two sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), PACK_END)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("packing", packing),
]

#: Fitted models and a tokenizer take part in every stage but one, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
