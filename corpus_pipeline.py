"""The corpus pipeline: from raw documents to token digests, each stage over all that the one before it kept.

Part of the ``llm`` subpackage, though it stands at the top. A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.llm import bpe, decontaminate, simhash, suffixdedup, toxicity
from lodestream.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; null and empty texts stay."""
    return toxicity.clean(docs, _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest id: candidates by SimHash fingerprints and the pigeonring, the farther ones by a prefix filter, then an exact check; null, empty and blank texts are copies of each other, and one of them stays. Rows without an id stay."""
    return simhash.without_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 48 words or more that stand anywhere else (over 50, of which the first and last may be joined to other characters); n_chars follows the text, a text that was null stays null."""
    known = docs.withColumn("_null", F.col("text").isNull())
    cut = suffixdedup.deduplicated(known, units=(suffixdedup.PASSAGES,))
    return cut.withColumn("text", F.when(~F.col("_null"), F.col("text"))).withColumn("n_chars", F.when(F.col("_null"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).drop("_null")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256."""
    ranks, pattern = bpe.default_vocabulary()
    return bpe.digests(docs.select("doc_id", "lang", "source", "n_chars", "text"), ranks, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", tokenize),
]

#: The stages' methods can't be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
