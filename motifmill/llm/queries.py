"""The registered queries of the numbered operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, hard_negatives, hnsw, ngram_filter, packing, paragraph_minhash, periodic_runs, quality, simhash, spotsigs, suffix_dedup, toxicity, url_rules
from .common import table
from .sql import OP3, OP8, OP11, OP12


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document; null ids name no component."""
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to; null texts count as empty."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op3_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector; unusable ones link with nothing."""
    return hnsw.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict of every document; texts labelled good are the trusted ones."""
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op6_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under the model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = ngram_filter.remainder()
    model = ngram_filter.train(docs, rest != 2)
    got = ngram_filter.score(docs, model)
    return got.select("doc_id", (ngram_filter.remainder() == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line or block of lines' words that occurs again, with its class."""
    return paragraph_minhash.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier one has, as counts and a digest."""
    got = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    got = spotsigs.edited_likeness(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    got = toxicity.score(docs, model)
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op11_four_russians_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive; of ids that 7 divides the label is moved on by one first."""
    vectors, moved = table(spark, sf_dir, "embeddings"), (F.col("label") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


#: Host, path and verdict of the rules that the pages are judged by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return got.select("page_id", "host", "path", "rule", "verdict")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, some documents having been given a periodic tail, and digests of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    got = periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(docs, "h"))
    line = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_hnsw_near_dedup": op3_hnsw_near_dedup,
    "op4_packing": op4_packing,
    "op5_kneser_ney_quality": op5_kneser_ney_quality,
    "op6_log_frequency_bloom": op6_log_frequency_bloom,
    "op7_paragraph_minhash": op7_paragraph_minhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_spotsigs": op9_spotsigs,
    "op10_toxicity": op10_toxicity,
    "op11_four_russians_hard_negatives": op11_four_russians_hard_negatives,
    "op12_url_rules": op12_url_rules,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op3_hnsw_near_dedup": OP3, "op8_suffix_dedup": OP8, "op11_four_russians_hard_negatives": OP11, "op12_url_rules": OP12}
