"""The everyday runs as one call each: training rows, and predictions next to the truth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from formulary.functions import predicates as P
from formulary.operators import prompts, sampling
from formulary.operators.generation import Client, Model, RetryPolicy, call_with_retry, generate
from formulary.operators.prompts import ChatTemplate
from formulary.operators.results import chain_stages, pending
from formulary.plans.prompt_spec import spec
from formulary.sources import ranges


def training_data(corpus: DataFrame, family: str, setting: str, version: str = "raw", seed: int = 0) -> DataFrame:
    """(row_id, nl, label) or (row_id, messages) for one task variant; noise is drawn where it asks for it."""
    if spec(family, setting, version)["preds_from"] == "own_noise":
        corpus = sampling.with_noise(corpus, seed=seed)
    if family == "seq2seq":
        return prompts.seq2seq_prompt(corpus, setting, version)
    return prompts.chat_train(corpus, setting, version)


def predict(
    corpus: DataFrame,
    load: Callable[[], Model],
    family: str,
    setting: str,
    version: str = "raw",
    batch_size: int = 32,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = False,
    seed: int = 0,
) -> DataFrame:
    """(row_id, nl, prompt, fol_pred, fol_gt): one answer per row of (row_id, nl, fol) and what the variant needs."""
    corpus = _with_noise(corpus, family, setting, version, seed)
    return generate(_asked(corpus, family, setting, version, template, add_generation_prompt), load, batch_size)


def _with_noise(corpus: DataFrame, family: str, setting: str, version: str, seed: int) -> DataFrame:
    noisy = spec(family, setting, version)["preds_from"] == "own_noise"
    return sampling.with_noise(corpus, seed=seed) if noisy else corpus


def _asked(
    corpus: DataFrame,
    family: str,
    setting: str,
    version: str,
    template: ChatTemplate,
    add_generation_prompt: bool,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(row_id, nl, prompt, fol_gt) and the columns to `keep`."""
    asked = prompts.route_prompts(corpus, [(family, setting, version)], keep=("nl", "fol", *keep))
    if family != "seq2seq":
        turns = F.array(prompts.message("system", F.col("system")), prompts.message("user", F.col("nl")))
        asked = asked.withColumn("prompt", prompts.render_chat(turns, template, add_generation_prompt))
    return asked.select("row_id", "nl", "prompt", F.col("fol").alias("fol_gt"), *keep)


def _in_ranges(
    corpus: Callable[[], DataFrame],
    spark: SparkSession,
    out_dir: str,
    range_rows: int,
    answer: Callable[[DataFrame], DataFrame],
    done: DataFrame | None,
    stop_after: int | None,
    tasks: int | None,
) -> DataFrame:
    """Answers of all rows, committed range by range in one job; see sources.ranges.

    The first call plans the run: it writes the rows down and so fixes their ranges. Later calls, for the same
    corpus, ask only ranges that are not committed. Rows that have a result in `done` by then are not asked.
    `tasks` bounds the tasks that ask at a time.
    """
    root = out_dir.rstrip("/")
    if ranges.planned(spark, root) is None:
        rows = corpus()
        ranges.plan_ranges(spark, rows if done is None else pending(rows, done), root, range_rows)
    rows, count = ranges.open_ranges(spark, root, stop_after)
    schema = T.StructType([f for f in answer(rows.limit(0)).schema if f.name != ranges.RANGE])
    if count:
        rows = rows if done is None else pending(rows, done)
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = ranges.dealt(rows, min(count, tasks or width))
        ranges.write_ranges(answer(ranges.skip_committed(dealt, root)), root)
    return ranges.answers(spark, root, schema)


def predict_resumable(
    corpus: DataFrame,
    load: Callable[[], Model],
    out_dir: str,
    family: str,
    setting: str,
    version: str = "raw",
    batch_size: int = 32,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = False,
    seed: int = 0,
    batch_rows: int = 100_000,
    done: DataFrame | None = None,
    stop_after: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """What predict gives, written under `out_dir`; a call after a broken one goes on where it broke.

    The rows are cut into ranges of up to `batch_rows` once, by the first call, and each range is committed by
    the task that has answered it; any row_id will do. A broken run asks again at most the ranges that were
    being answered. `done` (nl, ...) holds answers of other runs, `stop_after` ends the call after so many
    ranges, `profile` asks for what each task of the model needs (see generate).
    """
    spark = corpus.sparkSession

    def answer(rows: DataFrame) -> DataFrame:
        keep = (ranges.RANGE,)
        asked = _asked(rows, family, setting, version, template, add_generation_prompt, keep)
        return generate(asked, load, batch_size, profile=profile)

    rows = partial(_with_noise, corpus, family, setting, version, seed)
    return _in_ranges(rows, spark, out_dir, batch_rows, answer, done, stop_after, None)


FEW_SHOT_SETTINGS = {
    "none": "standard",
    "own": "gt_predicates",
    "own_noise": "gt_predicates_noise",
    "reasoning": "reasoning",
}


def predict_remote(
    corpus: DataFrame,
    make_client: Callable[[], Client],
    out_dir: str,
    mode: str,
    policy: RetryPolicy = RetryPolicy(),
    make_fallback: Callable[[], Client] | None = None,
    seed: int = 0,
    batch_rows: int = 1_000,
    done: DataFrame | None = None,
    stop_after: int | None = None,
    in_flight: int | None = None,
) -> DataFrame:
    """One remote request per row with the worked examples of `mode`: none, own, own_noise or reasoning.

    (row_id, nl, fol_pred, fol_gt, reasoning, fallback_used, status, attempts, error), committed range by range
    as predict_resumable does, so what has been paid for is kept. At most `in_flight` requests are open at a
    time over the whole cluster: that many divided by the threads of a task is the number of tasks. Speculative
    attempts of Spark would come on top.
    """
    setting = FEW_SHOT_SETTINGS[mode]
    spark = corpus.sparkSession
    tasks = None
    if in_flight is not None:
        if in_flight < 1:
            raise ValueError("at least one request in flight")
        policy = replace(policy, threads=min(policy.threads, in_flight))
        tasks = in_flight // policy.threads

    def answer(rows: DataFrame) -> DataFrame:
        keep = ("nl", "fol", ranges.RANGE)
        asked = prompts.route_prompts(rows, [("few_shot", setting, "raw")], keep=keep).select("row_id", "system", *keep)
        answered = call_with_retry(asked, make_client, policy, make_fallback)
        return answered.select(
            ranges.RANGE,
            "row_id",
            "nl",
            "fol_pred",
            F.col("fol").alias("fol_gt"),
            F.col("fol_pred_reasoning").alias("reasoning"),
            "fallback_used",
            "status",
            "attempts",
            "error",
        )

    rows = partial(_with_noise, corpus, "few_shot", setting, "raw", seed)
    return _in_ranges(rows, spark, out_dir, batch_rows, answer, done, stop_after, tasks)


def predict_in_two_steps(
    corpus: DataFrame,
    load_first: Callable[[], Model],
    load_second: Callable[[], Model],
    family: str,
    version: str = "raw",
    second_version: str = "raw",
    batch_size: int = 32,
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """First the predicates, then the formula from the predicted predicates; truth of both steps is kept.

    `store` may write the first answers down and read them back, so that a lost task of the second step
    does not ask the first model again.
    """
    first = predict(corpus, load_first, family, "2step_1", version, batch_size)
    first = store(first.select("row_id", F.col("fol_pred").alias("preds_pred")))
    second = predict(
        chain_stages(first, corpus), load_second, family, "2step_2", second_version, batch_size
    )
    truth = P.bare_list(P.sorted_names(P.extract_predicates("fol_gt")))
    return second.withColumn("preds_gt", truth)
