"""Result tables: resume, merge, harmonise, join back to their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from formulary.operators.skew import HEAVY_ROWS, lookup_join, text_key

# Spellings met in stored results, by canonical column.
SPELLINGS = {
    "nl": ["nl", "NL"],
    "prompt": ["prompt", "PROMPT"],
    "fol_pred": ["fol_pred", "FOL_PRED", "PRED"],
    "fol_gt": [
        "fol_gt",
        "FOL_GROUND-TRUTH",
        "FOL-GROUND-TRUTH",
        "GROUND-TRUTH",
        "fol_gt_underscore",
        "fol_gt_hyphen",
    ],
    "preds_pred": ["preds_pred", "PREDICATES_PRED"],
    "preds_gt": ["preds_gt", "PREDICATES_GROUND-TRUTH", "PREDICATES-GROUND-TRUTH"],
    "reasoning": ["reasoning", "FOL_PRED_REASONING"],
    "fallback_used": ["fallback_used", "FALLBACK_USED"],
}
DONE_KEYS = {"_key", "_done"}  # columns of a table of keys, one row each
ERROR = "ERROR"  # fixed value: stored in place of a prediction that never came


def pending(corpus: DataFrame, done: DataFrame, min_heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Corpus rows whose sentence has no result yet; a NULL sentence counts as done if a NULL result exists.

    Only 64-character keys are shuffled for the done side, and each key once. `done` may also be the table that
    sources.writers.write_done_keys keeps: its buckets are read as they lie, and only corpus rows are shuffled.
    """
    if DONE_KEYS <= set(done.columns):
        keys = done.select("_key", "_done")
    else:
        keys = done.select(text_key("nl").alias("_key")).distinct().withColumn("_done", F.lit(True))
    rows = corpus.withColumn("_key", text_key("nl"))
    marked = lookup_join(rows, keys, "_key", "_done", ["row_id"], min_heavy_rows)
    return marked.filter(F.col("_done").isNull()).drop("_key", "_done")


def attach_predictions(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with their model output; `row_id` is unique on both sides."""
    return inputs.join(outputs, "row_id")


def chain_stages(stage1: DataFrame, corpus: DataFrame) -> DataFrame:
    """First-step answers as second-step input, ground truth recovered from the corpus."""
    truth = corpus.select("row_id", "nl", "fol")
    return stage1.select("row_id", "preds_pred").join(truth, "row_id")


def merge_results(done: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier results and new ones; a column missing on one side becomes NULL."""
    return done.unionByName(new, allowMissingColumns=True)


def combine_corpora(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), dedup: bool = False) -> DataFrame:
    """Two corpora as one with a `source` column; optionally one row per (nl, fol), lowest (source, row_id)."""
    both = a.withColumn("source", F.lit(names[0])).unionByName(b.withColumn("source", F.lit(names[1])))
    if not dedup:
        return both
    kept = both.groupBy("nl", "fol").agg(F.min(F.struct("source", "row_id")).alias("k"))
    return kept.select("nl", "fol", F.col("k.source").alias("source"), F.col("k.row_id").alias("row_id"))


def nonempty_conclusions(df: DataFrame) -> DataFrame:
    """Rows that are worth a model call."""
    return df.filter(F.coalesce(F.col("conclusion"), F.lit("")) != "")


def blank_if_missing(c: str) -> Column:
    """Result text of a conclusion that was never sent."""
    return F.coalesce(F.col(c), F.lit(""))


def errors_to_requeue(df: DataFrame) -> DataFrame:
    return df.filter(F.col("fol_pred") == ERROR)


def harmonise_results(df: DataFrame) -> DataFrame:
    """Canonical columns for any stored variant: spellings merged, absent columns added as NULL.

    Columns that are no spelling of anything are kept as they are.
    """
    # Column lookup ignores case unless told otherwise, so match on the exact stored name.
    present = set(df.columns)
    known = {s for spellings in SPELLINGS.values() for s in spellings}
    out = [F.col(f"`{c}`") for c in df.columns if c not in known]
    for name, spellings in SPELLINGS.items():
        found = [F.col(f"`{s}`") for s in spellings if s in present]
        kind = "boolean" if name == "fallback_used" else "string"
        out.append((F.coalesce(*found) if found else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def progress(
    corpus: DataFrame, results: DataFrame, batch_size: int = 32, runs: DataFrame | None = None
) -> DataFrame:
    """Rows, results and batches per (model, setting); with `runs` (model, setting) also those without results."""
    total = corpus.agg(F.count("*")).scalar()
    done = results.groupBy("model", "setting").agg(F.count("*").alias("done"))
    if runs is not None:
        none = runs.select("model", "setting", F.lit(0).cast("bigint").alias("done"))
        done = done.unionByName(none).groupBy("model", "setting").agg(F.max("done").alias("done"))
    return done.withColumn("total", total).select(
        "model",
        "setting",
        "total",
        "done",
        F.expr(f"(total + {batch_size} - 1) div {batch_size}").alias("batches"),
        F.expr(f"(done + {batch_size} - 1) div {batch_size}").alias("batches_done"),
    )
