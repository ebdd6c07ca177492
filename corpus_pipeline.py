"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns what it leaves of docs; the
next one reads that back from Parquet. All but the last return the columns of
docs. Texts may be null or empty, rows may repeat and columns may be added;
what each operator makes of these is said in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociworks.llm import bpe, decontamination, quality_rules, secrets, simhash
from lociworks.llm.common import checkpointed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage occurs go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are written over; no document goes."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", hide_secrets),
    ("bpe_encoding", encode),
]

#: No SQL for run(): fertility bands and Markov models have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each result written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
