"""The corpus pipeline: stages that each take what the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

language_id  judges every document by op8: drops those whose language it cannot tell, which are those
             without a letter, and gives each other one the language it predicts; a given language stays
             only where the model could not learn it
exact_dedup  keeps of equal texts (A-Z lower-cased) the one with the largest doc_id
ngram_join   keeps one document, that with the smallest doc_id, of each group that links reach
             (word 5-grams, Jaccard of at least 0.8)
mixing       repeats documents by Poisson counts so that sources approach their target weights
packing      cuts documents into pieces and packs these into sequences of 1024 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, language_id, mixing, ngram_join, packing
from lodestone.llm.base import materialize
from lodestone.session import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, relabel=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each_group(docs, percent=80, words=5)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, copy=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, keep_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: A language model, tokens and bin packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
