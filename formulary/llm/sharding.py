"""Shards by jump consistent hashing: a key and the number of shards decide, without a table of the ring.

One more shard takes its share of the rows and moves no others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from formulary.llm.tables import numbered

STEP = np.uint64(2862933555777941757)  # fixed by the published method


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of every 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard")
    keys = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    at = np.full(len(keys), -1.0)
    ahead = np.zeros(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = ahead
            at = ahead
            keys = keys * STEP + np.uint64(1)
            ahead = np.floor((at + 1) * (float(1 << 31) / ((keys >> np.uint64(33)).astype(np.float64) + 1)))
            on = ahead < shards
            live, keys, ahead = live[on], keys[on], ahead[on]
    return out


def shard_of(key: str | Column, shards: int) -> Column:
    """int column: the shard of a bigint key, in Arrow batches."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards), dtype="int32")

    return place(key)


def sharded(docs: DataFrame, shards: int = 24, grown: int = 25) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with `grown` shards) of every row.

    The stable key is a hash of doc_id, so rows with one id, and all rows without one, share a shard. size is
    the UTF-8 bytes of the text and 8 more; a null text has none, and crc32 0. Slots number a shard's rows
    without gaps; repeated rows have slots of their own. Only doc_id and text are read. The narrow rows are
    written when this is called.
    """
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(content) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("bigint")).alias("key"),
    )
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        shard_of("key", shards).alias("shard"),
        shard_of("key", grown).alias("grown_shard"),
    )
    out = numbered(rows, ["shard"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )
