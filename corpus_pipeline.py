"""The corpus pipeline: documents are filtered, deduplicated and packed.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``pricelake.llm`` on all that its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricelake.llm import line_dedup, packing, quality_classifier, quality_rules, simhash_dedup
from pricelake.llm.common import prepare, table

TOKENIZER = os.path.join(public_tokenizers.path(""), "word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.5)."""
    return quality_classifier.keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the outlier test of their language and source."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without three-line windows that occur earlier."""
    prepare(spark)
    return line_dedup.deduped_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: three-word shingles, at most three bits."""
    prepare(spark)
    return simhash_dedup.keep_first(docs, shingle=3, max_bits=3)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_classifier", quality), ("quality_rules", rules), ("line_dedup", lines),
          ("simhash_dedup", near_duplicates), ("packing", sequences)]

#: The classifier, the estimates and the packing have no SQL form; tests hold the stages against
#: plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    from pricelake.session import freeze

    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
