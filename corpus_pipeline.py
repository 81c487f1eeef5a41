"""From raw documents to encoded ones: each stage takes the documents that the one before it kept.

quality classifier (rejected documents go) - n-gram Jaccard join (one document of each group stays) - substring dedup
(repeated passages go out of the texts) - benchmark decontamination (documents that cover an item go) - BPE encoding and
decoding (ids and decoded texts as digests). All but the last return the columns of documents, whichever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumicat.llm import bpe, decontaminate, ngram_join, quality, substring_dedup
from lumicat.llm.base import ready, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the model rejects; documents without text are scored like any other."""
    ready(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies."""
    ready(spark)
    return ngram_join.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out that stand earlier in what is left."""
    ready(spark)
    return substring_dedup.strip(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that cover a benchmark item."""
    ready(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_roundtrip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ready(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_roundtrip", bpe_roundtrip),
]

#: Learnt weights and the tokenizer can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
