"""What several operators of this subpackage share: inputs, row keys, dense numbering."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from formulary.session import store

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that nothing refers to any more.

    Spark does so some time after the driver has collected garbage; between the phases of one operator that
    may be too late, so this collects, twice as the first round only finds what can go, and gives it a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def stored(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """`df` as a table written in the shared folder. `heavy`: what led to it shuffled much that can go now."""
    out = store(df, name)
    if heavy:
        release(df.sparkSession)
    return out


def numbered(df: DataFrame, by: list[str], name: str = "idx") -> DataFrame:
    """Adds `name`: 0, 1, 2, ... without gaps within each group `by`.

    The rows are written down once, each with the partition it lay in and its place there, so a lost
    executor changes no number. Groups are counted per partition; only these counts are ordered within
    a group, so a group that holds most rows is still numbered by many tasks. Hand in narrow rows.
    """
    place = {
        "_pid": F.spark_partition_id(),
        "_pos": F.monotonically_increasing_id(),
    }
    kept = stored(df.withColumns(place), "numbered")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in by]
    kept = kept.withColumn("_by", F.xxhash64(*keys, *by))
    within = Window.partitionBy("_pid", "_by").orderBy("_pos")
    sizes = kept.groupBy("_pid", "_by").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_by").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_pid", "_by", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    ranked = kept.withColumn("_n", F.row_number().over(within) - 1)
    out = ranked.join(first, ["_pid", "_by"])
    return out.withColumn(name, F.col("_first") + F.col("_n")).drop("_pid", "_pos", "_by", "_c", "_first", "_n")
