"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirwise.llm import lines, packing, pii, quality, simhash
from dirwise.llm.common import reachable, read_table
from dirwise.session import shared_dir

VOCABULARY = "word_bpe_49k.json"


def _beside(docs: DataFrame, operator, *own: str) -> DataFrame:
    """An operator's result where ``docs`` keep the columns that are called like the operator's own."""
    aside = {c: f"{c}__kept" for c in own if c in docs.columns}
    out = operator(docs.withColumnsRenamed(aside))
    return out.drop(*aside).withColumnsRenamed({k: c for c, k in aside.items()})


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with the number of characters brought up to date."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (6), fitted on the labelled ones, does not reject."""
    reachable(spark)
    field = quality.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return _beside(docs, lambda rows: quality.scored(rows, field).where("predicted = 1"), "score", "predicted").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (5): lines that an earlier document holds go; documents that lose all their lines stay, empty."""
    return _as_documents(_beside(docs, lines.deduplicated, "n_lines", "n_dropped"), docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (4): the smallest id of every group stays."""
    reachable(spark)
    return simhash.keep_first(docs).select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (8): entities become surrogates."""
    reachable(spark)
    return _as_documents(_beside(docs, pii.pseudonymised, "n_entities"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (7): the pieces of all sequences."""
    reachable(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", keep_first), ("pii", pseudonymise), ("packing", pack)]
#: A fitted classifier and a tokenizer cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again as the next one's documents."""
    home = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{name}")
    return docs
