"""A training corpus from raw documents: classify, filter, drop near copies, cut repeats, pack.

Every stage reads what the one before it wrote; all but the last return the
columns of documents, in their order, and whatever others there are.

Cases: the stages follow their operators.  An empty table stays empty and packs
to no rows; without labels the classifier rejects nothing; nulls in metadata
are values of their own.  A null, empty or short text fails the quality rules
(fewer than 20 words).  Rows of a null doc_id are never copies of others and
keep their passages; of rows that repeat doc_id and text one stays, while
different texts of one doc_id are documents of their own.  Very long texts are
worked on whole.  Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrules.llm import minhash_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from sparkrules.llm.common import delete, read, store


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality_classifier.keep(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the compression bands."""
    return quality_rules.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.keep(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return suffix_dedup.remove(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers as vocabularies

    path = vocabularies.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("minhash_dedup", distinct),
    ("suffix_dedup", unrepeated),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if last is not None:  # nothing reads it any more
            delete(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
