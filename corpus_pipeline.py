"""A corpus run through five of the operators, one stage after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formulary.llm import jaccard, mixing, packing, substrings, toxicity
from formulary.llm.tables import DOC_COLUMNS, table
from formulary.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ORACLE_SQL = None  # trained models, random rounding and a search are not SQL
PASSAGE_WORDS, PASSAGE_SEED = 50, 8


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject, unchanged."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs.select(DOC_COLUMNS), model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, unchanged, of every class of near-duplicates."""
    return jaccard.one_per_class(docs.select(DOC_COLUMNS))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document with a smaller doc_id has too."""
    return substrings.without_repeats(docs.select(DOC_COLUMNS), PASSAGE_WORDS, PASSAGE_SEED)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mixing.mix(docs.select(DOC_COLUMNS))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces with their places in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_duplicates_out),
    ("substring dedup", repeats_out),
    ("mixing sources to target weights", to_target_weights),
    ("best-fit packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
