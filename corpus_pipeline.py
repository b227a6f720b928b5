"""A corpus pipeline: quality, line dedup, near-duplicates, mixing, tokens; each stage on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formproof.llm import bpe, lines, mix, quality, setjoin
from formproof.llm.common import deleted, noted, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_done: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before has left in the scratch folder: its result is written by then."""
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        deleted(_done, spark)
        _done.clear()
        with noted(_done):
            return work(spark, docs, sf_dir)
    return run


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.score(docs, table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat in others."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@stage
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five words, 0.8)."""
    classes = setjoin.similar_sets(docs, words=5, percent=80)
    kept = classes.where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_id"))).select(COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the words taken of each document, a row for each time it is taken."""
    return mix.mixed_documents(docs).select(COLUMNS)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and proof that they decode to it."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_decode(docs, vocabulary, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "source", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids",
        (F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES = [
    ("quality", keep_quality), ("line_dedup", drop_lines), ("near_duplicates", keep_one_of_similar),
    ("mix", mix_sources), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to shared storage and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
