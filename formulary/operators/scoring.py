"""Comparing predicted and true formulas, and rolling the outcome up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from formulary.functions import predicates as P, text as X
from formulary.operators.results import ERROR


def predicate_matches(pairs: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """One row per predicted predicate: the nearest true one, its distance, whether it is near enough.

    Each row's names are compared inside the row, so candidate pairs never become table rows.
    """
    named = pairs.select(
        *keys,
        P.extract_predicates("fol_pred").alias("n1"),
        F.array_distinct(P.extract_predicates("fol_gt")).alias("n2"),
    )
    one = named.select(*keys, "n2", F.posexplode_outer("n1").alias("pos", "pred"))
    near = one.filter(F.col("pred").isNotNull() & (F.size("n2") > 0)).withColumn("near", P.nearest(F.col("pred"), F.col("n2")))
    return near.select(
        *keys,
        "pos",
        "pred",
        F.col("near.name").alias("best"),
        F.col("near.d").alias("distance"),
        (F.col("near.d") <= P.MAX_NORM_DISTANCE).alias("accepted"),
    )


def match_predicates(pairs: DataFrame, pred: str = "fol_pred", gt: str = "fol_gt") -> DataFrame:
    """Adds `aligned`: the predicted formula with its predicates renamed to the true ones."""
    named = pairs.withColumns(
        {"_n1": P.extract_predicates(pred), "_n2": F.array_distinct(P.extract_predicates(gt))}
    )
    # Renaming is skipped where nothing can change; the conditions keep both lists referenced more than
    # once, so the extraction stays in its own projection instead of being repeated per element.
    usable = (F.size("_n1") > 0) & (F.size("_n2") > 0)
    aligned = F.when(usable, P.rename_in_order(pred, P.renames("_n1", "_n2"))).otherwise(F.col(pred))
    return named.withColumn("aligned", aligned).drop("_n1", "_n2")


def verdicts(predictions: DataFrame) -> DataFrame:
    """Adds `formula`, `aligned`, `verdict`: error, identical, identical_after_match or open."""
    cleaned = predictions.withColumn("formula", X.after_last_equals("fol_pred"))
    matched = match_predicates(cleaned, "formula")
    verdict = (
        F.when(F.col("fol_pred").isNull() | (F.col("fol_pred") == ERROR), "error")
        .when(X.identical("formula", "fol_gt"), "identical")
        .when(X.identical("aligned", "fol_gt"), "identical_after_match")
        .otherwise("open")
    )
    return matched.withColumn("verdict", verdict)


def scorecard(judged: DataFrame) -> DataFrame:
    """Rates per (model, setting), per model, and overall.

    `judged` is the output of `verdicts`; a boolean column `parse_ok`, if present, gives the parse rate.
    Rows are counted once per (model, setting); the roll-up then only sees those few groups.
    """
    with_parse = "parse_ok" in judged.columns
    is_ = lambda *names: F.count_if(F.col("verdict").isin(*names))
    parts = {
        "n_rows": F.count("*"),
        "n_errors": is_("error"),
        "n_identical": is_("identical"),
        "n_aligned": is_("identical", "identical_after_match"),
    }
    if with_parse:
        parts["n_parsed"] = F.count_if("parse_ok")
    counts = judged.groupBy("model", "setting").agg(*[c.alias(n) for n, c in parts.items()])
    rolled = counts.rollup("model", "setting").agg(
        F.grouping_id().cast("bigint").alias("level"), *[F.sum(n).alias(n) for n in parts]
    )
    rate = lambda n: F.round(F.col(n) / F.col("n_rows"), 6)
    out = [
        "model",
        "setting",
        "level",
        "n_rows",
        "n_errors",
        rate("n_identical").alias("identical_rate"),
        rate("n_aligned").alias("aligned_rate"),
    ]
    if with_parse:
        out.append(rate("n_parsed").alias("parse_rate"))
    return rolled.select(*out)


def predicate_inventory(corpus: DataFrame) -> DataFrame:
    """Every predicate with its number of uses and of rows using it.

    The row count sums a first-in-row flag, so one shuffle of partial sums serves both counts.
    """
    names = corpus.select(P.extract_predicates("fol").alias("names"))
    # An outer explode: the plain one makes Spark test the list for emptiness first, by extracting it twice.
    uses = names.select(F.posexplode_outer("names").alias("pos", "pred"), "names").filter(F.col("pred").isNotNull())
    flagged = uses.select("pred", (F.array_position("names", F.col("pred")) == F.col("pos") + 1).alias("first"))
    return flagged.groupBy("pred").agg(F.count("*").alias("uses"), F.count_if("first").alias("rows_using"))
