"""A training-data pipeline: five filters and encoders in a row over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.

Defined results, for all stages: an empty table gives an empty one; null and empty texts
are texts like any other; a row is told by its doc_id, null ones included, and its text,
so of rows that share a doc_id only those with a dropped text go; columns beyond doc_id
and text are passed on unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.llm import decontaminate, exact_dedup, simhash, sp_sampling, toxicity
from setlist.llm.common import durable, small_batches, table, without
from setlist.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine, learnt from their labels, scores under 0.5; repeated rows each. Without labels of both kinds it scores all rows the share of toxic labels."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (null: empty; A-Z lower-cased): one with the largest doc_id, any of equal rows."""
    small_batches(spark)
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: one with the smallest doc_id, any of equal rows. Texts without words are near copies of each other."""
    small_batches(spark)
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with no word in a benchmark passage, or less than one in twenty; repeated rows each. A null or blank passage is none."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each row, two unless its text has only one: ids, log probability and log inclusion score; rows with equal ids and texts get equal ones."""
    small_batches(spark)
    return sp_sampling.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained first stage and the sampling last one are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
