"""Registered queries of the operators: one ``opN_<name>`` each over its whole table, ``pipeline``,
and DuckDB SQL where SQL can express the rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.llm import byte_bpe, chat_format, collocations, embedding_dedup, html_extract, line_dedup, packing, quality_classifier, quality_rules, ranked_search, simhash_dedup, token_counts, warc
from pricelake.llm.common import prepare, table
from pricelake.session import scratch_path

#: Folder of the tokenizer files; every operator takes the path as a parameter.
TOKENIZERS = public_tokenizers.path("")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@_query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels outside the held-out third train the network."""
    prepare(spark)
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base verdict and robust outlier verdict of every document."""
    prepare(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@_query("op5_simhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at three-word shingles and three bits."""
    prepare(spark)
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@_query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the three-line windows that occur earlier in the corpus."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs)


@_query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, "word_bpe_49k.json"))


@_query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    prepare(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, "byte_bpe_50k.json"))


@_query("op6_chat_format", chat_format.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    prepare(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.formatted(turns.unionByName(own)))


@_query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    prepare(spark)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))


@_query("op1_html_extract")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"))


@_query("op3_embedding_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    prepare(spark)
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


@_query("op12_warc_bundles", warc.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records into seekable bundles, and read back through the index."""
    prepare(spark)
    index = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, f"warc-{uuid.uuid4().hex}"))
    return warc.read(index).select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                   F.col("refers_to").cast("bigint").alias("refers_to"))


@_query("op13_ranked_search", ranked_search.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    prepare(spark)
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@_query("op11_phrase_collocations", collocations.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents."""
    prepare(spark)
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, top=2000)
