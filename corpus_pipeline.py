"""The document pipeline: quality, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import packing, quality, simhash, suffix_dedup, toxicity
from motifmill.llm.common import stored, table


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is beyond their language's trusted quantile go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts to be toxic go; rows kept from learning are as in its query."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def merge_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints chain up, the one with the least id stays."""
    return simhash.keep_one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that an earlier document has go; texts and their lengths change, rows stay."""
    return suffix_dedup.texts_without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", reject_poor), ("toxicity", reject_toxic), ("simhash", merge_near_copies), ("suffix", cut_repeats), ("packing", pack)]

#: No stage of models and fingerprints can be said in SQL; the tests hold each against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read by the next.

    Null and empty texts pass the filters as texts without words and are packed as one end id; rows with null ids are
    never merged with others, and of rows that repeat id and text one is left; other columns are carried along. An empty
    table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
