"""Registered queries: each runs one operator over whole given tables and returns flat columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from formulary import schemas
from formulary.functions import predicates as P, text as X
from formulary.operators import (
    context,
    encoding,
    formulas,
    generation,
    metrics,
    prompts,
    results,
    sampling,
    scoring,
)
from formulary.plans import doubles, flows
from formulary.plans import fixed_texts as t
from formulary.plans.fixtures import view
from formulary.plans.prompt_spec import ROWS, model_family as family_of
from formulary.session import scratch_path, store
from formulary.sources import readers, writers
from formulary.sources.ranges import ATTEMPTS
from formulary.streaming import predictions as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCAB_SIZE = 5000  # of vocab_build, whose feature it is
BATCH = 32
FIXED_LENGTH = 512
TRAINING_LENGTH = 250
MODELS_HOME = "/models"
LABELS = "CASE example_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'Uncertain' END"
FILE_ROWS = 150
IN_FLIGHT = 20  # remote requests
BUCKETS = 8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- inputs ----------------------------------------------------------------------------------------


def spread(table: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is spread over them; any larger one is left alone."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spread(view(spark, sf, "fol_corpus"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return spread(view(spark, sf, "fol_predictions"))


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spread(view(spark, sf, name))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).withColumnRenamed("doc_id", "row_id")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """One row per example. The view puts four formulas into each, so the groups are small by construction."""
    rows = view(spark, sf, "fol_premises")
    premise = F.when(F.col("kind") == "premise", F.struct("idx", "text", "fol"))
    conclusion = F.when(F.col("kind") == "conclusion", F.struct("text", "fol"))
    grouped = rows.groupBy("example_id").agg(
        F.sort_array(F.collect_list(premise)).alias("p"), F.max(conclusion).alias("c")
    )
    return grouped.select(
        "example_id",
        F.col("p.text").alias("premises"),
        F.coalesce("c.text", F.lit("")).alias("conclusion"),
        F.expr(LABELS).alias("label"),
        F.col("p.fol").alias("premises_fol"),
        F.coalesce("c.fol", F.lit("")).alias("conclusion_fol"),
    )


def _joined(c: str, sep: str = " ") -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), sep)


# -- sources and sinks -----------------------------------------------------------------------------


def _as_arrays(rows, path):
    """One file per task, all of its rows as one JSON array, the way each split of a corpus is stored."""
    lines = rows.select(F.to_json(F.struct(F.col("nl").alias("NL"), F.col("fol").alias("FOL"))).alias("value"))

    def framed(batches):
        mark = "["
        for batch in batches:
            values = batch.column("value").to_pylist()
            out = [f"{mark if k == 0 else ','}{v}" for k, v in enumerate(values)]
            mark = "," if values else mark
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])

    lines.mapInArrow(framed, "value string").write.text(path)


@query
def read_pairs_json(spark, sf):
    """Arrays of many rows, read in ranges of 64 KiB."""
    path = scratch_path(spark, "pairs")
    _as_arrays(corpus(spark, sf), path)
    return readers.read_pairs_json(spark, path, 64 << 10)


@query
def read_examples_jsonl(spark, sf):
    path = scratch_path(spark, "examples")
    examples(spark, sf).select("premises", "conclusion", "label").write.json(path)
    read = readers.read_examples_jsonl(spark, path)
    return read.select(_joined("premises", "|").alias("premises"), "conclusion", "label")


@query
def read_split(spark, sf):
    path = scratch_path(spark, "splits")
    corpus(spark, sf).write.partitionBy("split").parquet(path)
    return readers.read_split(spark, path, "val").select("row_id", "nl", "fol", "split")


@query
def training_languages(spark, sf):
    return readers.training_languages(view(spark, sf, "documents"), ["de", "en"]).select("doc_id", "lang", "n_chars")


@query
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    named = predictions(spark, sf).withColumn("model", F.concat(F.lit("org/"), "model"))
    writers.write_predictions(named.select("row_id", "nl", "fol_pred", "fol_gt", "model", "setting"), path)
    back = "row_id bigint, nl string, fol_pred string, fol_gt string, model string, setting string"
    return spark.read.schema(back).json(path)


@query
def write_examples_jsonl(spark, sf):
    path = scratch_path(spark, "example-results")
    writers.write_examples_jsonl(examples(spark, sf), path)
    back = spark.read.schema(schemas.EXAMPLE_RESULT_FILE).json(path)
    return back.select(
        _joined("premises-FOL", "|").alias("premises_fol"),
        F.col("conclusion-FOL").alias("conclusion_fol"),
        "conclusion",
        "label",
    )


@query
def append_progress(spark, sf):
    path = scratch_path(spark, "progress")
    rows = predictions(spark, sf).select("row_id", "run", "fol_pred")
    for batch_id in [0, 1, 1]:  # the second batch is written twice, as after a crash
        writers.append_progress(rows.filter(F.col("run") == batch_id), path, batch_id)
    return spark.read.parquet(path).select("row_id", "run", "fol_pred", F.col("batch_id").cast("bigint"))


# -- prompts ---------------------------------------------------------------------------------------


@query
def seq2seq_prompt(spark, sf):
    return prompts.seq2seq_prompt(corpus(spark, sf))


@query
def chat_train(spark, sf):
    return prompts.messages_to_rows(prompts.chat_train(corpus(spark, sf)))


@query
def chat_infer(spark, sf):
    return prompts.chat_infer(corpus(spark, sf), add_generation_prompt=True)


@query
def seq2seq_prompt_given_preds(spark, sf):
    return prompts.seq2seq_prompt_given_preds(corpus(spark, sf), "utils")


@query
def chat_given_preds(spark, sf):
    return prompts.messages_to_rows(prompts.chat_given_preds(corpus(spark, sf)))


@query
def prompt_noisy_preds(spark, sf):
    return sampling.prompt_noisy_preds(corpus(spark, sf))


@query
def chat_noisy_preds(spark, sf):
    return prompts.messages_to_rows(sampling.prompt_noisy_preds(corpus(spark, sf), "chat", version="utils"))


@query
def extract_task(spark, sf):
    return prompts.extract_task(corpus(spark, sf))


@query
def stage2_prompt(spark, sf):
    return prompts.stage2_prompt(view(spark, sf, "fol_stage1")).select("row_id", "nl")


@query
def stage2_chat(spark, sf):
    return prompts.messages_to_rows(prompts.stage2_prompt(view(spark, sf, "fol_stage1"), "chat"))


@query
def few_shot_chat(spark, sf):
    return prompts.messages_to_rows(prompts.few_shot_chat(corpus(spark, sf), "own"))


@query
def drop_source_columns(spark, sf):
    built = corpus(spark, sf).withColumn("label", X.label("fol", "phi_fol"))
    return prompts.drop_source_columns(built, "chat")


@query
def route_prompts(spark, sf):
    requests = [r[:3] for r in ROWS if r[5] in ("none", "own", "own_noise")]
    return prompts.route_prompts(sampling.with_noise(corpus(spark, sf)), requests)


@query
def route_prompts_given(spark, sf):
    """The variants whose text depends on what a model said before, and the premise chain."""
    thoughts = F.when(F.col("row_id") % 2 == 1, F.concat(F.lit("I think "), "nl"))
    rows = corpus(spark, sf).join(view(spark, sf, "fol_stage1").select("row_id", "preds_pred"), "row_id")
    requests = [r[:3] for r in ROWS if r[5] in ("predicted", "thoughts", "context")]
    return prompts.route_prompts(rows.withColumn("thoughts", thoughts), requests)


@query
def nonempty_conclusions(spark, sf):
    ends = view(spark, sf, "fol_premises").filter(F.col("kind") == "conclusion")
    return results.nonempty_conclusions(ends.select("example_id", F.col("text").alias("conclusion")))


@query
def errors_to_requeue(spark, sf):
    return results.errors_to_requeue(predictions(spark, sf)).select("row_id", "run", "nl")


@query
def result_files(spark, sf):
    """Every stored variant written, read back and brought to one set of columns."""
    path = scratch_path(spark, "result-files")
    rows = predictions(spark, sf).withColumns(
        {
            "prompt": F.concat(F.lit("Q: "), "nl"),
            "preds_pred": F.array_join(P.sorted_names(P.extract_predicates("fol_pred")), ", "),
            "preds_gt": F.array_join(P.sorted_names(P.extract_predicates("fol_gt")), ", "),
            "reasoning": F.concat(F.lit("because "), "model"),
            "fallback_used": F.col("run") == 1,
        }
    )
    for variant in writers.RESULT_VARIANTS:
        writers.write_results(rows, f"{path}/variant={variant}", variant)
    return results.harmonise_results(readers.read_results(spark, path, folders="variant"))


@query
def harmonise_results(spark, sf):
    return results.harmonise_results(view(spark, sf, "fol_stage1"))


# -- joins and sets --------------------------------------------------------------------------------


@query
def pending(spark, sf):
    return results.pending(corpus(spark, sf), view(spark, sf, "results_done")).select("row_id", "nl")


@query
def pending_bucketed(spark, sf):
    """As pending, with the keys of the results kept in buckets, the second half added to the first."""
    done = view(spark, sf, "results_done")
    name, path = f"done_keys_{uuid.uuid4().hex}", scratch_path(spark, "done-keys")
    half = F.coalesce(F.pmod(F.xxhash64("nl"), F.lit(2)), F.lit(0)) == 0
    for part in (done.filter(half), done):
        keys = writers.write_done_keys(part, name, path, BUCKETS)
    return results.pending(corpus(spark, sf), keys).select("row_id", "nl")


@query
def noise_rows(spark, sf):
    drawn = sampling.noise_rows(corpus(spark, sf))
    return drawn.select("row_id", "peer_id", F.array_join("preds", ",").alias("preds"))


@query
def predicate_matches(spark, sf):
    matches = scoring.predicate_matches(predictions(spark, sf), ("row_id", "run"))
    return matches.withColumns({"pos": F.col("pos").cast("bigint"), "distance": F.round("distance", 6)})


@query
def attach_predictions(spark, sf):
    outputs = predictions(spark, sf).select("row_id", "run", "fol_pred")
    return results.attach_predictions(corpus(spark, sf).select("row_id", "nl"), outputs)


@query
def chain_stages(spark, sf):
    return results.chain_stages(view(spark, sf, "fol_stage1"), corpus(spark, sf))


@query
def union_predicates(spark, sf):
    own = P.extract_predicates("fol_gt")
    both = P.sorted_names(own, P.extract_predicates("fol_pred"))
    return predictions(spark, sf).select("row_id", "run", F.array_join(both, ",").alias("preds"))


@query
def merge_results(spark, sf):
    new = predictions(spark, sf).select("nl", "fol_pred", F.lit(True).alias("fallback_used"))
    return results.merge_results(view(spark, sf, "results_done"), new)


def _two_corpora(spark, sf):
    rows = corpus(spark, sf).select("row_id", "nl", "fol")
    again = predictions(spark, sf).select("row_id", "nl", F.col("fol_pred").alias("fol"))
    return rows, again


@query
def combine_corpora(spark, sf):
    return results.combine_corpora(*_two_corpora(spark, sf))


@query
def combine_corpora_dedup(spark, sf):
    return results.combine_corpora(*_two_corpora(spark, sf), dedup=True)


# -- aggregations and windows ----------------------------------------------------------------------


@query
def predicate_inventory(spark, sf):
    return scoring.predicate_inventory(corpus(spark, sf))


@query
def noise_predicate_set(spark, sf):
    names = sampling.noise_predicate_set(sampling.noise_rows(corpus(spark, sf)))
    return names.select("row_id", F.array_join("noise", ",").alias("noise"))


@query
def progress(spark, sf):
    return results.progress(corpus(spark, sf), predictions(spark, sf), BATCH)


@query
def progress_of_runs(spark, sf):
    """A run that has no result yet is listed too."""
    rows = predictions(spark, sf)
    runs = rows.select("model", "setting").distinct().union(spark.sql("SELECT 'model_c', 'standard'"))
    return results.progress(corpus(spark, sf), rows, BATCH, runs)


@query
def best_epoch(spark, sf):
    return metrics.best_epoch(view(spark, sf, "train_metrics"))


@query
def early_stop(spark, sf):
    return metrics.early_stop(view(spark, sf, "train_metrics"))


@query
def scorecard(spark, sf):
    return scoring.scorecard(scoring.verdicts(predictions(spark, sf)))


@query
def scorecard_with_parse(spark, sf):
    judged = scoring.verdicts(predictions(spark, sf)).select("model", "setting", "verdict", "formula")
    sent = judged.withColumn("formula", F.when(F.col("verdict") != "error", F.col("formula")))
    return scoring.scorecard(formulas.parse_formulas(sent, "formula"))


def _statements(spark, sf):
    """Formulas plus one unary use of made_by per supplier."""
    unary = view(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("row_id"),
        F.concat(F.lit("made_by("), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(")")).alias("fol"),
    )
    return corpus(spark, sf).select("row_id", "fol").union(unary)


def _conflict_columns(df):
    return df.select("pred", _joined("arities", ",").alias("arities"), "uses")


@query
def arity_conflicts(spark, sf):
    return _conflict_columns(formulas.arity_conflicts(formulas.flat_arities(_statements(spark, sf))))


@query
def arity_conflicts_from_nodes(spark, sf):
    nodes = formulas.parse_nodes(_statements(spark, sf))
    return _conflict_columns(formulas.arity_conflicts(formulas.node_arities(nodes)))


@query
def vocab_build(spark, sf):
    return encoding.vocab_build(texts(spark, sf), VOCAB_SIZE)


@query
def premise_context(spark, sf):
    return context.premise_context(view(spark, sf, "fol_premises"))


@query
def conclusion_context(spark, sf):
    return context.conclusion_context(examples(spark, sf)).select("example_id", "context")


@query
def running_chat_context(spark, sf):
    rows = context.running_chat_context(view(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "turn", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


@query
def assign_batches(spark, sf):
    batches = sampling.assign_batches(corpus(spark, sf).select("row_id"), BATCH)
    return batches.select("row_id", "idx", "batch_id", "batch_start", "batch_end")


@query
def batch_slice(spark, sf):
    batches = sampling.assign_batches(corpus(spark, sf).select("row_id"), BATCH)
    return sampling.batch_slice(batches, 3).select("row_id", "idx", "batch_id")


@query
def batch_rows(spark, sf):
    batches = sampling.assign_batches(corpus(spark, sf).select("row_id"), BATCH)
    return sampling.batch_rows(batches).select("batch_id", _joined("row_ids").alias("row_ids"))


# -- scalar functions ------------------------------------------------------------------------------


@query
def extract_predicates(spark, sf):
    names = F.array_join(P.extract_predicates("fol_pred"), ",")
    return predictions(spark, sf).select("row_id", "run", names.alias("preds"))


@query
def sorted_names(spark, sf):
    names = F.array_join(P.sorted_names(P.extract_predicates("fol")), ",")
    return corpus(spark, sf).select("row_id", names.alias("preds"))


@query
def identical(spark, sf):
    return predictions(spark, sf).select("row_id", "run", X.identical("fol_pred", "fol_gt").alias("same"))


@query
def literals_to_words(spark, sf):
    return corpus(spark, sf).select(
        "row_id",
        X.literals_to_words("fol").alias("words"),
        X.literals_to_bracket_tokens("fol").alias("brackets"),
    )


@query
def tokens_to_literals(spark, sf):
    return corpus(spark, sf).select(
        "row_id",
        X.tokens_to_literals(X.literals_to_bracket_tokens("fol")).alias("from_brackets"),
        X.tokens_to_literals(X.literals_to_words("fol"), "words").alias("from_words"),
    )


@query
def after_last_equals(spark, sf):
    return predictions(spark, sf).select("row_id", "run", X.after_last_equals("fol_pred").alias("formula"))


@query
def predicted_list(spark, sf):
    return view(spark, sf, "fol_stage1").select(
        "row_id",
        X.predicted_list("preds_pred", "last_line").alias("last_line"),
        X.predicted_list("preds_pred", "last_marker").alias("last_marker"),
    )


@query
def format_predicates(spark, sf):
    names = P.sorted_names(P.extract_predicates("fol"))
    return corpus(spark, sf).select(
        "row_id", *[P.format_predicates(names, f).alias(f) for f in ["plain", "quoted", "plain_nl", "bare"]]
    )


@query
def clean_nl(spark, sf):
    text = F.concat(F.lit(t.TRANSLATE), "nl", F.lit(" \t"), "fol")
    return corpus(spark, sf).select("row_id", X.clean_nl(text, t.TRANSLATE).alias("nl"))


@query
def norm_distance(spark, sf):
    a, b = F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lower("p_type"), F.lit("_part"))
    return view(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.round(P.norm_distance(a, b), 6).alias("d"))


@query
def best_match(spark, sf):
    rows = predictions(spark, sf).select(
        "row_id", "run", P.extract_predicates("fol_pred").alias("p"), P.extract_predicates("fol_gt").alias("g")
    )
    return rows.select(
        "row_id", "run", F.array_join(F.transform("p", lambda a: P.best_match(a, "g")), ",").alias("best")
    )


@query
def match_predicates(spark, sf):
    return scoring.match_predicates(predictions(spark, sf)).select("row_id", "run", "aligned")


@query
def pad_truncate(spark, sf):
    lengths = documents(spark, sf).select("row_id", F.transform(X.words("text"), lambda w: F.length(w)).alias("ids"))
    fixed = encoding.fixed_length(lengths, FIXED_LENGTH)
    return fixed.select("row_id", _joined("input_ids").alias("input_ids"), _joined("attention_mask").alias("mask"))


@query
def base_model(spark, sf):
    start = F.expr("CASE lang WHEN 'de' THEN '/models' WHEN 'fr' THEN '/other' WHEN 'es' THEN '/models/hub/' ELSE '/models//hub' END")
    step = F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("/"), "lang"))
    path = F.concat(start, F.lit("/"), "source", step)
    return documents(spark, sf).select("row_id", X.base_model(path, MODELS_HOME).alias("model"))


@query
def safe_file_name(spark, sf):
    return view(spark, sf, "pages").select("page_id", X.safe_file_name("url").alias("name"))


@query
def label(spark, sf):
    names = P.format_predicates(P.sorted_names(P.extract_predicates("fol")), "plain")
    return corpus(spark, sf).select(
        "row_id", *[X.label("fol", kind, names).alias(kind) for kind in ["phi_fol", "fol", "list"]]
    )


@query
def next_stage(spark, sf):
    stage = F.concat(F.lit("curiculum_step"), F.col("p_size").cast("string"))
    return view(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), X.next_stage(stage).alias("stage"))


# -- encoding --------------------------------------------------------------------------------------


def _vocab(spark, sf):
    """Built once and written down, as a vocabulary is ready before anything is encoded."""
    return store(encoding.vocab_build(texts(spark, sf)), "vocab")


@query
def encode(spark, sf):
    ids = encoding.encode(documents(spark, sf), _vocab(spark, sf))
    return ids.select("row_id", _joined("ids").alias("ids"))


@query
def encode_by_join(spark, sf):
    ids = encoding.encode(documents(spark, sf), _vocab(spark, sf), max_shipped=0)
    return ids.select("row_id", _joined("ids").alias("ids"))


@query
def encode_repeated_ids(spark, sf):
    """Each row_id stands in two rows; the joined way keeps them apart as the shipped way does."""
    rows = predictions(spark, sf).select("row_id", F.col("fol_pred").alias("text"))
    ids = encoding.encode(rows, store(encoding.vocab_build(rows), "vocab"), max_shipped=0)
    return ids.select("row_id", _joined("ids").alias("ids"))


@query
def decode(spark, sf):
    vocab = _vocab(spark, sf)
    return encoding.decode(encoding.encode(documents(spark, sf), vocab), vocab)


@query
def training_rows(spark, sf):
    rows = prompts.seq2seq_prompt(corpus(spark, sf))
    vocab = store(encoding.vocab_build(rows, text="nl"), "vocab")
    fixed = encoding.training_rows(rows, vocab, TRAINING_LENGTH)
    return fixed.select("row_id", *[_joined(c).alias(c) for c in ["input_ids", "attention_mask", "labels"]])


@query
def extend_vocab(spark, sf):
    return encoding.extend_vocab(_vocab(spark, sf), [*X.BRACKETS, "the", "new_token"])


@query
def batch_pad(spark, sf):
    rows = documents(spark, sf)
    ids = encoding.encode(rows, _vocab(spark, sf))
    batched = sampling.assign_batches(ids, BATCH, keys=rows)
    padded = encoding.batch_pad(batched)
    return padded.select("row_id", "batch_id", _joined("padded").alias("padded"), _joined("mask").alias("mask"))


# -- formulas --------------------------------------------------------------------------------------


@query
def parse_nodes(spark, sf):
    return formulas.parse_nodes(corpus(spark, sf))


@query
def formula_profile(spark, sf):
    return formulas.formula_profile(corpus(spark, sf))


@query
def connective_profile(spark, sf):
    return formulas.connective_profile(corpus(spark, sf))


@query
def export_prover_text(spark, sf):
    return formulas.export_prover_text(examples(spark, sf))


@query
def verdicts(spark, sf):
    return scoring.verdicts(predictions(spark, sf)).select("row_id", "run", "verdict")


# -- generation and streaming ----------------------------------------------------------------------


@query
def generate(spark, sf):
    asked = prompts.seq2seq_prompt(corpus(spark, sf)).withColumnRenamed("nl", "prompt")
    return generation.generate(asked, doubles.load_echo, BATCH).select("row_id", "prompt", "fol_pred")


@query
def training_data(spark, sf):
    return prompts.messages_to_rows(flows.training_data(corpus(spark, sf), "chat", "new_tokens"))


@query
def predict(spark, sf):
    return flows.predict(corpus(spark, sf), doubles.load_last_turn, "chat", "standard")


def _resumed(spark, sf, setting):
    """A first call is cut short and leaves a half-written range; the second one goes on."""
    out = scratch_path(spark, "resumed")
    rows = corpus(spark, sf)
    batch_rows = max(1, rows.count() // 20)
    run = partial(flows.predict_resumable, rows, doubles.load_echo, out, "seq2seq", setting, batch_rows=batch_rows)
    run(stop_after=2)
    half = "row_id bigint, nl string, prompt string, fol_gt string, fol_pred string"
    spark.createDataFrame([(-1, "half", "half", "half", "half")], half).write.parquet(f"{out}/{ATTEMPTS}/half")
    run()
    return run()


@query
def predict_resumable(spark, sf):
    return _resumed(spark, sf, "standard")


@query
def predict_resumable_noisy(spark, sf):
    return _resumed(spark, sf, "gt_predicates_noise")


def _remote(spark, sf, mode):
    out = scratch_path(spark, "remote")
    run = partial(
        flows.predict_remote, corpus(spark, sf), doubles.flaky_client, out, mode, doubles.NO_WAIT, doubles.steady_client
    )
    return run(batch_rows=500, in_flight=IN_FLIGHT).drop("attempts", "error")


@query
def predict_remote_none(spark, sf):
    return _remote(spark, sf, "none")


@query
def predict_remote_own(spark, sf):
    return _remote(spark, sf, "own")


@query
def predict_remote_own_noise(spark, sf):
    return _remote(spark, sf, "own_noise")


@query
def predict_remote_reasoning(spark, sf):
    return _remote(spark, sf, "reasoning")


@query
def predict_in_two_steps(spark, sf):
    first = lambda df: store(df, "first-step")
    return flows.predict_in_two_steps(
        corpus(spark, sf), doubles.load_echo, doubles.load_echo, "seq2seq", store=first
    )


@query
def model_family(spark, sf):
    model = F.expr(
        "CASE lang WHEN 'de' THEN '/models/google-t5/t5-base/standard' WHEN 'fr' THEN 'google/flan-t5-xxl' "
        "WHEN 'es' THEN '/models/allenai/OLMo-2-0325-32B-Instruct/curiculum_step2' ELSE source END"
    )
    return documents(spark, sf).select("row_id", family_of(model, MODELS_HOME).alias("family"))


@query
def call_with_retry(spark, sf):
    asked = corpus(spark, sf).select("row_id", "nl", F.lit(t.FEW_SHOT_REASONING_HEAD + t.ANSWER).alias("system"))
    done = generation.call_with_retry(asked, doubles.flaky_client, doubles.NO_WAIT, doubles.steady_client)
    return done.select("row_id", "fol_pred", "fol_pred_reasoning", "status", "attempts", "fallback_used", "error")


@query
def generate_sequential(spark, sf):
    done = generation.generate_sequential(
        examples(spark, sf).drop("premises_fol", "conclusion_fol"), doubles.load_last_turn
    )
    return done.select("example_id", _joined("premises_fol", "|").alias("premises_fol"), "conclusion_fol")


@query
def stream_predictions(spark, sf):
    src, out, state = (scratch_path(spark, n) for n in ["stream-in", "stream-out", "stream-state"])
    pairs = corpus(spark, sf).select(F.col("nl").alias("NL"), F.col("fol").alias("FOL"), "row_id")
    files = pairs.withColumn("file", F.floor(F.col("row_id") / FILE_ROWS)).groupBy("file")
    arrays = files.agg(F.to_json(F.collect_list(F.struct("NL", "FOL"))).alias("value")).select("value")
    # All files lie in one folder: a folder each would be listed again and again, by a task each.
    arrays.write.option("maxRecordsPerFile", 1).text(src)
    for _ in range(2):  # the second run finds nothing new
        stream.stream_predictions(spark, src, out, state, doubles.load_echo).awaitTermination()
    return stream.stored(spark, out)
