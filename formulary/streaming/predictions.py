"""Corpus files in, predictions out, restartable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from formulary import schemas
from formulary.operators.generation import Model, generate
from formulary.operators.prompts import route_prompts
from formulary.operators.results import pending
from formulary.operators.skew import text_key
from formulary.sources.writers import append_progress


# What lies in a batch's folder besides the answers: the pair's key, in a folder per day on which it was seen.
KEY, DAY = "key", "day"
FOLDERS = [T.StructField("batch_id", T.LongType()), T.StructField(DAY, T.DateType())]
MAX_BROADCAST_KEYS = 1_000_000  # keys of one batch, of 32 bytes each
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pair_key(nl: str, fol: str) -> Column:
    return F.unhex(F.sha2(F.to_json(F.array(nl, fol)), 256))


def _written(spark: SparkSession, out_dir: str, fields: list[T.StructField]) -> DataFrame:
    try:
        return spark.read.schema(T.StructType([*fields, *FOLDERS])).parquet(out_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([*fields, *FOLDERS]))


def stored(spark: SparkSession, out_dir: str) -> DataFrame:
    """All predictions written so far."""
    return _written(spark, out_dir, schemas.ANSWERED.fields).select(*schemas.ANSWERED.names)


def older_keys(spark: SparkSession, out_dir: str, window: str, but: int) -> DataFrame:
    """Keys of the pairs answered on days that may lie beyond the query's state; other days are not read.

    The folder of batch `but` is left out, as a batch that is repeated has been written before.
    """
    last = F.date_add(F.to_date(F.current_timestamp() - F.expr(f"INTERVAL {window}")), 1)
    keys = _written(spark, out_dir, [T.StructField(KEY, T.BinaryType())])
    return keys.filter((F.col(DAY) < last) & (F.col("batch_id") != but)).select(KEY)


def _without_older(batch: DataFrame, batch_id: int, out_dir: str, window: str) -> DataFrame:
    older = older_keys(batch.sparkSession, out_dir, window, batch_id)
    if older.isEmpty():
        return batch
    keys = batch.select(KEY)
    if keys.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    # The batch's keys go to the stored ones, however many those are; what they meet is no larger than the batch.
    return batch.join(older.join(keys, KEY, "left_semi").distinct(), KEY, "left_anti")


def predict_batch(
    batch: DataFrame,
    batch_id: int,
    out_dir: str,
    load: Callable[[], Model],
    request: tuple[str, str, str] = ("seq2seq", "standard", "raw"),
    batch_size: int = 32,
    done: DataFrame | None = None,
    window: str = "7 days",
) -> None:
    """One micro-batch of row_id, nl, fol, key and seen: what was answered longer than `window` ago, or in `done`, is
    left out, the rest answered. A repeated batch replaces its own rows.
    """
    batch.persist()  # read more than once, while the query's state is stepped once
    todo = _without_older(batch, batch_id, out_dir, window)
    todo = pending(todo, done) if done is not None else todo
    prompts = route_prompts(todo, [request], keep=("nl", "fol", KEY, "seen"))
    asked = prompts.select("nl", "prompt", F.col("fol").alias("fol_gt"), KEY, F.to_date("seen").alias(DAY))
    answered = generate(asked, load, batch_size)
    append_progress(answered, out_dir, batch_id, [DAY])
    batch.unpersist()


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within an Arrow batch go before the shuffle, so one frequent sentence fills no task."""
    for batch in batches:
        codes = batch.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        yield batch.take(pa.array(np.sort(np.unique(codes, return_index=True)[1])))


@contextmanager
def _large_state(spark: SparkSession) -> Iterator[None]:
    """All keys of a window are kept, so a query started here keeps them in RocksDB, not in the executors' heaps.

    A provider that the session names stays. A started query has a copy of the settings, so they are put back.
    """
    if spark.conf.get(PROVIDER, None) is not None:
        yield
        return
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER)


def stream_predictions(
    spark: SparkSession,
    src_dir: str,
    out_dir: str,
    checkpoint: str,
    load: Callable[[], Model],
    request: tuple[str, str, str] = ("seq2seq", "standard", "raw"),
    batch_size: int = 32,
    files_per_batch: int | None = None,
    done: DataFrame | None = None,
    window: str = "7 days",
) -> StreamingQuery:
    """Predict once per sentence and formula for the corpus files that appear in `src_dir`, then stop.

    A restart goes on behind the checkpoint. Pairs seen within `window` are known from the query's state by a key
    of 32 bytes; older keys leave the state and are looked up in the output, of which only the keys of days
    that old are read. So the state ends with the window, and no pair is answered twice. `done` adds results
    that are older than the query. A sentence with several true formulas is answered next to each of them. The
    state lies in RocksDB unless the session names another store; a checkpoint keeps the one it began with.
    """
    reader = spark.readStream.schema(schemas.PAIR_FILE).option("multiLine", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The time of the batch, which a repeated batch has again: no pair is ever late.
    pairs = reader.json(src_dir).select(
        pair_key("NL", "FOL").alias(KEY),
        text_key("NL").alias("row_id"),
        F.col("NL").alias("nl"),
        F.col("FOL").alias("fol"),
        F.current_timestamp().alias("seen"),
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        predict_batch(batch, batch_id, out_dir, load, request, batch_size, done, window)

    first = pairs.mapInArrow(_first_of_each, pairs.schema)
    new = first.withWatermark("seen", window).dropDuplicatesWithinWatermark([KEY])
    query = new.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _large_state(spark):
        return query.start()
