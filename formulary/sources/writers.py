"""Writing predictions and examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from formulary.functions.text import safe_file_name
from formulary.operators.skew import text_key


def write_predictions(df: DataFrame, root: str, fmt: str = "json") -> None:
    """One folder per (model, setting), replaced on rewrite.

    The rebalance hint gives each folder few files, and splits a folder that holds most of the rows.
    """
    out = df.withColumns({"model": safe_file_name("model"), "setting": safe_file_name("setting")})
    out.hint("rebalance", "model", "setting").write.mode("overwrite").partitionBy("model", "setting").format(
        fmt
    ).save(root)


def write_examples_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per example, UTF-8, hyphenated names, nothing dropped when null."""
    df.select(
        "premises",
        F.col("premises_fol").alias("premises-FOL"),
        "conclusion",
        F.col("conclusion_fol").alias("conclusion-FOL"),
        "label",
    ).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_progress(df: DataFrame, path: str, batch_id: int, folders: Sequence[str] = ()) -> None:
    """Add one batch. A repeated batch_id replaces its own rows only, so a retry adds nothing.

    `folders` are columns by which the batch is laid out below its own folder. For whole runs see sources.ranges.
    """
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (out.partitionBy(*folders) if folders else out).parquet(f"{path.rstrip('/')}/batch_id={int(batch_id)}")


# The stored names of each variant's columns.
_TWO_STEPS = {"NL": "nl", "PREDICATES_PRED": "preds_pred"}
RESULT_VARIANTS = {
    "seq2seq": {"NL": "nl", "PRED": "fol_pred", "GROUND-TRUTH": "fol_gt"},
    "chat": {"PROMPT": "prompt", "PRED": "fol_pred"},
    "raw": {"NL": "nl", "FOL_PRED": "fol_pred", "FOL_GROUND-TRUTH": "fol_gt"},
    "first_step": {**_TWO_STEPS, "PREDICATES_GROUND-TRUTH": "preds_gt", "FOL_GROUND-TRUTH": "fol_gt"},
    "first_step_hyphen": {**_TWO_STEPS, "PREDICATES_GROUND-TRUTH": "preds_gt", "FOL-GROUND-TRUTH": "fol_gt"},
    "second_step": {
        **_TWO_STEPS,
        "FOL_PRED": "fol_pred",
        "PREDICATES-GROUND-TRUTH": "preds_gt",
        "FOL_GROUND-TRUTH": "fol_gt",
    },
    "second_step_hyphen": {
        **_TWO_STEPS,
        "FOL_PRED": "fol_pred",
        "PREDICATES-GROUND-TRUTH": "preds_gt",
        "FOL-GROUND-TRUTH": "fol_gt",
    },
    "remote": {
        "NL": "nl",
        "FOL_PRED": "fol_pred",
        "FOL_GROUND-TRUTH": "fol_gt",
        "FOL_PRED_REASONING": "reasoning",
        "FALLBACK_USED": "fallback_used",
    },
}


def write_results(df: DataFrame, path: str, variant: str) -> None:
    """Results as JSON lines under the stored names of a variant; columns it does not store are left out."""
    names = RESULT_VARIANTS[variant]
    out = df.select(*[F.col(c).alias(stored) for stored, c in names.items()])
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_done_keys(done: DataFrame, table: str, path: str | None = None, buckets: int = 200) -> DataFrame:
    """Keeps the keys of answered sentences in a bucketed table, made here or added to, and returns that table.

    `done` has the column nl. Each key is stored once. `path` and `buckets` are those of the first call. Calls
    for one table come one after the other.
    """
    spark = done.sparkSession
    keys = done.select(text_key("nl").alias("_key")).distinct().withColumn("_done", F.lit(True))
    known = spark.catalog.tableExists(table)
    if known:
        keys = keys.join(spark.table(table).select("_key"), "_key", "left_anti")
    # Keys lie by bucket before they are written, so that each bucket gets one file a call.
    out = keys.repartition(buckets, "_key").write.bucketBy(buckets, "_key").sortBy("_key").format("parquet")
    if path and not known:
        out = out.option("path", path)
    out.mode("append").saveAsTable(table)
    return spark.table(table)
