"""Per-epoch losses: best epoch and early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

INF = float("inf")


def _loss() -> Column:
    """A loss that is no number never improves on anything."""
    return F.when(F.col("eval_loss").isNull() | F.isnan("eval_loss"), F.lit(INF)).otherwise(F.col("eval_loss"))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """Epoch with the smallest loss per run, the earliest on ties. One shuffle of partial minima."""
    usable = F.when(_loss() < INF, F.struct(_loss().alias("eval_loss"), F.col("epoch")))
    best = metrics.groupBy("run_id").agg(F.min(usable).alias("b"))
    return best.select("run_id", F.col("b.epoch").alias("best_epoch"), F.col("b.eval_loss").alias("best_loss"))


def early_stop(metrics: DataFrame, patience: int = 4, width: int = 4096) -> DataFrame:
    """First epoch after `patience` epochs without strict improvement, and the best epoch up to there.

    Runs may be long, so no window spans a run: epochs are cut into buckets of `width`, each bucket knows
    the minimum and count before it, and only one summary row per bucket is ordered within the run. Run and
    epoch identify a row and are never NULL.
    """
    rows = metrics.select(
        "run_id", "epoch", _loss().alias("loss"), F.floor(F.col("epoch") / width).alias("bucket")
    )
    in_run = Window.partitionBy("run_id").orderBy("bucket")
    before_bucket = in_run.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("run_id", "bucket")
        .agg(F.min("loss").alias("m"), F.count("*").alias("n"))
        .select(
            "run_id",
            "bucket",
            F.coalesce(F.min("m").over(before_bucket), F.lit(INF)).alias("min_before"),
            F.coalesce(F.sum("n").over(before_bucket), F.lit(0)).alias("n_before"),
        )
    )

    in_bucket = Window.partitionBy("run_id", "bucket").orderBy("epoch")
    earlier = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_bucket.rowsBetween(Window.unboundedPreceding, 0)
    x = rows.join(carried, ["run_id", "bucket"]).withColumns(
        {
            "k": F.row_number().over(in_bucket).cast("bigint"),
            "best": F.least("min_before", F.coalesce(F.min("loss").over(earlier), F.lit(INF))),
        }
    )
    x = x.withColumns({"pos": F.col("n_before") + F.col("k"), "better": F.col("loss") < F.col("best")})
    here = F.struct(F.col("pos"), F.col("epoch"))
    x = x.withColumn("last", F.max(F.when(F.col("better"), here)).over(so_far))
    stop = F.struct(F.col("pos"), F.col("epoch"), F.col("last.epoch").alias("best_epoch"))
    buckets = x.groupBy("run_id", "bucket").agg(
        F.first("n_before").alias("n_before"),
        F.coalesce(F.min(F.when(F.col("better"), F.col("k"))) - 1, F.count("*")).alias("lead_in"),
        F.sort_array(
            F.collect_list(F.when(F.col("k") <= patience, F.struct("k", "epoch")))
        ).alias("head"),
        F.max(F.when(F.col("better"), here)).alias("last"),
        F.min(F.when(F.col("pos") - F.col("last.pos") >= patience, stop)).alias("inside"),
    )
    # A stop counted from an earlier bucket falls into the rows before this bucket's first improvement.
    b = buckets.withColumn("carry", F.max("last").over(before_bucket))
    at = F.col("carry.pos") + patience - F.col("n_before")
    in_lead = (at >= 1) & (at <= F.col("lead_in"))
    crossing = F.when(
        in_lead,
        F.struct(
            (F.col("carry.pos") + patience).alias("pos"),
            F.get("head", (at - 1).cast("int"))["epoch"].alias("epoch"),
            F.col("carry.epoch").alias("best_epoch"),
        ),
    )
    runs = b.groupBy("run_id").agg(
        F.min(F.least(F.coalesce(crossing, F.col("inside")), F.coalesce(F.col("inside"), crossing))).alias("s"),
        F.max("last").alias("final"),
    )
    return runs.select(
        "run_id",
        F.col("s.epoch").alias("stop_epoch"),
        F.coalesce("s.best_epoch", "final.epoch").alias("best_epoch"),
    )
