"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to
their targets and what is left is packed into sequences.  Each stage is written as Parquet and read again by the next.

What a stage writes on its way lies in a scope of the shared folder, which the next stage drops at its start: by then the result of the one before
is Parquet.  One pipeline runs at a time in an application.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ballast.functions.store import discard, scope, tidy, written
from ballast.llm.minhash_dedup import deduplicated
from ballast.llm.mixing import mixed
from ballast.llm.packing import pack
from ballast.llm.toxicity import score_documents

#: No SQL: the first stage fits a model and the last one tokenizes.
ORACLE_SQL = None


SCOPE = "pipeline"


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, SCOPE)
        tidy(spark)
        with scope(SCOPE):
            return work(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is 0.3 or more go, rows with a null or empty text are scored like others; columns stay as they are, and repeated rows share their fate."""
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with 80 % of their shingles of five words in common the one with the smallest id stays; rows without words or id stay."""
    return deduplicated(docs, percent=80, width=5)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some twice, to the sources' targets; documents without words are not taken."""
    return mixed(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; a null text is one piece, the end token alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
