"""A training-text pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes the documents that its predecessor kept, as written, and all but the last return the columns of ``documents``. Further columns are
carried whatever their names, and an empty table stays empty in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import bpe, mixing, near_dup, pii, quality
from twinfold.llm.common import staged_alone, table


#: Words kept by a tokens worker; fewer than bpe.ENCODED, as executors still hold the memory of the stages before.
MEMO = 100_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules. Null, empty and blank texts fail; each row is judged alone, so repeated rows stay or go together."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; similarity is 0.8 over shingles of five words.

    Texts without words are groups of their own; all rows with the doc_id that is kept stay; a row without a doc_id stays only where its group has no other.
    """
    return near_dup.keep_one(docs, near_dup.STAGE_WORDS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows. Every row stays; null and empty texts are left as they are."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most. A null source is a source of its own; texts without words are not taken; repeated rows are taken alike."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row, repeated ones again; a null text counts as an empty one and has no tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, MEMO)


STAGES = [("quality rules", rules), ("near-duplicates", one_of_each), ("personal data", private), ("mixing", mixture), ("tokens", tokens)]

#: Byte-pair merges are not expressed in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = staged_alone(spark, lambda step=step, docs=docs: step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
