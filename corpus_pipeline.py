"""A training corpus from raw documents: language ID, exact and near deduplication,
decontamination, packing.

Each stage takes (spark, docs, sf_dir).  All but the last give the rows that
stay, with the columns of documents; the last gives the pieces of sequences.
Between stages the rows are written to the shared folder as Parquet and reread,
so that a stage's several passes don't run its predecessors again and a lost
executor costs one stage's tasks at most.

What holds for every stage: each row is judged by itself, also where doc_id is
null or repeats; other columns are carried along, whatever their names; very
long texts are read whole; an empty table stays empty.

A stage sets spark.sql.execution.arrow.maxRecordsPerBatch of the session to 1024
at most: at Spark's default of 10,000 rows a batch of documents takes tens of
megabytes on either side of each of an executor's cores.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicell.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from lumicell.llm.common import bound_batches, crc_mod, saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with null text, without letters or with no language of probability 0.5 go.

    The model is learned from the input's own rows with a lang; if there are
    none, only documents without letters go.
    """
    bound_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays; null counts as the smallest, and of rows that share it one stays.

    Null and empty texts are equal.
    """
    bound_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links the smallest doc_id stays; null counts as the largest, ties go by the text's hash.

    Documents without words link with nothing and stay.
    """
    bound_batches(spark)
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts and items match nothing."""
    bound_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a null or empty text has its end id alone."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has neither the language model nor the tokenizer; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
