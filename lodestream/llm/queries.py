"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.llm.oracles import ORACLES  # noqa: F401  part of what this module registers
from lodestream.llm import bpe, decontaminate, embeddings, langid, licenses, ngramlm, simhash, suffixdedup, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages, mixture of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches of every document."""
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, contaminated, coverage, item_id, n_tiles of every document against the whole benchmark."""
    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.weak_labels(pages))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.documents_digests(spark, _table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, for strings of 400 bytes; n_passages, n_passage_words for passages of 48 words."""
    return suffixdedup.digests(_table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector at cosine 0.9."""
    return embeddings.near(_table(spark, sf_dir, "embeddings"), least=0.9)


def op8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, log_score, score, n_backoffs of every document against the counts of all others."""
    found = ngramlm.score(_table(spark, sf_dir, "documents"))
    return found.withColumns({"log_score": F.round("log_score", 6), "score": F.round("score", 8)})


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, and the component of every document."""
    found = simhash.groups(_table(spark, sf_dir, "documents"), words_each=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_embeddings": op7_embeddings,
    "op8_backoff": op8_backoff,
    "op9_licenses": op9_licenses,
    "op10_simhash": op10_simhash,
}