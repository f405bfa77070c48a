"""The subpackage's queries, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.llm import chat_format, embedding_dedup, minhash_dedup, ngram_scoring, packing, pieces, quality_classifier, quality_rules, sql, suffix_dedup, toxicity
from sparkrules.llm.common import read


def op1_packing(spark, sf_dir):
    import public_tokenizers as vocabularies

    path = vocabularies.path
    return packing.pack(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


def op2_ngram_scoring(spark, sf_dir):
    return ngram_scoring.score(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def op4_sentencepiece(spark, sf_dir):
    import public_tokenizers as vocabularies

    return pieces.digests(read(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeats(read(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark, sf_dir):
    return minhash_dedup.groups(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark, sf_dir):
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_chat_format(spark, sf_dir):
    return chat_format.segments(read(spark, sf_dir, "conversations"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.measure(read(spark, sf_dir, "documents"))


# what SQL can express of operators that it cannot express as a whole


def ngram_base_figures(spark, sf_dir):
    return op2_ngram_scoring(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 3))


def suffix_dedup_words(spark, sf_dir):
    return op5_suffix_dedup(spark, sf_dir).select("doc_id", "n_shared_words", "n_removed_words")


def quality_rules_figures(spark, sf_dir):
    return op10_quality_rules(spark, sf_dir).drop("kept", "ratio", "bad_share")


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_ngram_scoring": op2_ngram_scoring,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_chat_format": op9_chat_format,
        "op10_quality_rules": op10_quality_rules,
        "ngram_base_figures": ngram_base_figures,
        "suffix_dedup_words": suffix_dedup_words,
        "quality_rules_figures": quality_rules_figures,
    }


def oracle_sql() -> dict:
    return {
        "op6_minhash_dedup": sql.MINHASH,
        "op7_embedding_dedup": sql.EMBEDDING,
        "op9_chat_format": chat_format.SQL,
        "ngram_base_figures": sql.NGRAM_BASE,
        "suffix_dedup_words": sql.SUFFIX_WORDS,
        "quality_rules_figures": sql.RULE_FIGURES,
    }
