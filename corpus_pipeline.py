"""A document corpus from raw text to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns to the shared checkpoint folder and hands the reread table
to the next one. All stages but the last return the columns of documents.

1. quality: documents that the rule ensemble rejects go.
2. near duplicates: one document of each SimHash component stays.
3. decontamination: benchmark passages are cut out; documents of nothing else go.
4. personal data: every span is replaced by its kind.
5. packing: the rows of sequences of at most 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiscope.llm import decontam, packing, pii, quality, simhash
from kpiscope.llm.common import table
from kpiscope.llm.queries import MAX_BITS, SHINGLE_WORDS, tokenizer_file
from kpiscope.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, SHINGLE_WORDS, MAX_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers of earlier stages still hold memory: smaller parts of text and fewer cached words than alone
    return packing.pack(docs, tokenizer_file(), part_bytes=5_000_000, cache_words=150_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

# the classifier, fingerprints and packing are beyond SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
