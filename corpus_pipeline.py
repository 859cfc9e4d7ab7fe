"""A corpus from raw documents: quality rules, near duplicates, repeats, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

A null, empty or blank text fails the quality rules and goes in the first stage; if a later stage leaves
a text empty, the document stays and packs as its end id alone. Long texts pass every stage whole.
Repeated rows and equal sets of shingles are one group, of which the least doc_id stays (of equal ones,
any one row); a null doc_id comes after all others. Extra columns pass the first four stages unchanged,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import ngram_join, packing, pii, quality, suffix_dedup
from tracklake.llm.common import documents, written

import public_tokenizers  # after the package, whose absence is the one that the entry module expects


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least doc_id, of each group of linked ones."""
    return ngram_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of PASSAGE (240) bytes or more, so passages of some 50 words, that are found elsewhere in the corpus from the texts."""
    return suffix_dedup.cut_repeats(docs, suffix_dedup.PASSAGE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data."""
    return pii.surrogates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences; a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("PII surrogates", personal_data),
    ("packing", packed),
]

#: SQL can express neither the tokenizer nor the surrogates; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-").lower())
    return docs
