"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The most frequent keys travel by broadcast. Any key outside the first 1000 owns less than a
# thousandth of the rows, so an ordinary shuffle spreads the rest.
HEAVY_KEYS = 1000
HEAVY_ROWS = 100_000


def heavy_keys(rows: DataFrame, key: str, min_rows: int = HEAVY_ROWS) -> DataFrame:
    """At most HEAVY_KEYS keys with at least `min_rows` rows. Counts are combined before the shuffle."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") >= min_rows).orderBy(F.desc("_n"), key).limit(HEAVY_KEYS).select(key)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    payload: str,
    spread: list[str],
    min_rows: int = HEAVY_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """rows left-joined to `lookup` (unique on `key`, one `payload` column).

    `weight` names a lookup column with the number of rows per key; without it the rows are counted.

    Heavy keys get their payload from a broadcast of bounded size. For the shuffle join that serves all
    other keys their rows, and those without a key, receive stand-in keys that match nothing. Those are a
    hash of the `spread` columns, so a recomputed task sends every row to the same place again.
    """
    if weight is None:
        heavy = heavy_keys(rows.select(key), key, min_rows).join(lookup, key, "left")
    else:
        heavy = lookup.filter(F.col(weight) >= min_rows).orderBy(F.desc(weight), key).limit(HEAVY_KEYS)
    heavy = heavy.select(F.col(key).alias("_hk"), F.col(payload).alias("_hp"), F.lit(True).alias("_hot"))
    tagged = rows.join(F.broadcast(heavy), rows[key] == F.col("_hk"), "left").drop("_hk")
    stand_in = F.concat(F.lit("\x00"), F.xxhash64(*spread).cast("string"))
    tagged = tagged.withColumn("_jk", F.when(F.col("_hot") | F.col(key).isNull(), stand_in).otherwise(F.col(key)))
    light = lookup.select(F.col(key).alias("_jk"), F.col(payload).alias("_lp"))
    joined = tagged.join(light, "_jk", "left")
    return joined.withColumn(payload, F.coalesce("_hp", "_lp")).drop("_jk", "_hp", "_lp", "_hot")


def text_key(c) -> Column:
    """256-bit key of a string; NULL has a key of its own."""
    return F.coalesce(F.sha2(c, 256), F.lit("-"))
