"""Registered queries of the numbered operators: each applies one operator to its whole table.

SQL holds the checking SQL of some of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formulary.llm import ann, codes, jaccard, leaks, licences, middle, mixing, packing, sharding, simhash, substrings, toxicity, warc
from formulary.llm.oracle import SQL
from formulary.llm.tables import table

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf, "documents"))


@query
def op3_hnsw(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, found by the graphs of all shards."""
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, sf, "documents"))


@query
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf, "documents"))


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf, "pages"), min_bytes=0)


@query
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, class_id and n_links of every document: five-word shingles, similarity of 0.8 or more."""
    return jaccard.jaccard_join(table(spark, sf, "documents"))


@query
def op8_jump_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(table(spark, sf, "documents"), shards=24, grown=25)


@query
def op9_pivotal_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))


@query
def op10_bin_completion(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return middle.middle_digests(table(spark, sf, "documents"))


@query
def op12_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.decontaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_metric_tree_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Eight parts, codebooks of 16 entries, six rounds over every vector."""
    return codes.compressed(table(spark, sf, "embeddings"), parts=8, entries=16, rounds=6)
