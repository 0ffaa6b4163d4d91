"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from formulary.llm.tables import stored


def _larger(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the least of the vertex and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written down, so both sides of the join are plain exchanges, in which Spark splits a vertex of many edges.
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    tied = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return tied.filter("a != b").distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the least of them. Edges run from larger to smaller."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    tied = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every vertex of `edges` (a, b of one ordered type) but a component's least, tied to that least one.

    Larger and smaller neighbours are tied in turn, which needs few rounds even for long chains; each round is
    a written table. A vertex with very many edges is aggregated before the shuffle and met by a join only.
    """
    at = stored(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        after = stored(_smaller(stored(_larger(at), "edges")), "edges")
        # Stars, and nothing but stars, are left as they are.
        changed = after.join(at, ["a", "b"], "left_anti").limit(1).count() or (after.count() != at.count())
        if not changed:
            return after
        at = after
