"""The corpus pipeline: stages that each call one operator, joined by Parquet tables.

All stages take null texts as empty, whole texts however long, tables without rows, and columns of any other names; the first four
return the columns that they get. Null doc_ids are kept like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import lines, packing, quality, simhash, substrings
from ledgerlake.llm.common import documents, stored
from ledgerlake.llm.queries import WORD_VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects; null and empty texts are rejected, as they have too few words. Repeated rows are judged one by one."""
    return quality.cascade(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least ten of them have; repeated rows count as often as they occur. Null and empty texts are one empty line, which stays."""
    return lines.drop_frequent(docs, min_docs=10, min_chars=1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five-word shingles, similarity 0.8. The smallest doc_id stays, nulls last, then the least text hash; of
    equal rows one stays. Texts without words all stay."""
    return simhash.one_of_each(docs, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words that one of a smaller doc_id has; equal doc_ids keep theirs, null doc_ids neither lose nor take away words."""
    return substrings.removed(docs, window=50, whole=True).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens: a row a piece, with the columns of packing alone. A null or empty text is its end token; repeated rows are packed as often as they occur."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packed),
]

#: SQL has no tokenizer, XXH64 or sum-of-squares packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
