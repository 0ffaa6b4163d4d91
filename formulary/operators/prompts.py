"""Prompts and chats for every task variant. Projections only: no shuffle, no Python."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from formulary.functions import predicates as P, text as X
from formulary.plans import fixed_texts as t
from formulary.plans.prompt_spec import spec


@dataclass(frozen=True)
class ChatTemplate:
    """How a model family writes a chat as one string; these few literals replace a template engine."""

    before_role: str = "<|"
    after_role: str = "|>\n"
    close: str = "\n"
    generation: str = "<|assistant|>\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_chat(messages, template: ChatTemplate, add_generation_prompt: bool = False) -> Column:
    turns = F.transform(
        X._col(messages),
        lambda m: F.concat(
            F.lit(template.before_role), m["role"], F.lit(template.after_role), m["content"], F.lit(template.close)
        ),
    )
    suffix = template.generation if add_generation_prompt else ""
    return F.concat(F.array_join(turns, ""), F.lit(suffix))


def _literal_spec(family: str, setting: str, version: str) -> dict[str, Column]:
    return {name: F.lit(value) for name, value in spec(family, setting, version).items()}


def _names(df: DataFrame, formula: Column) -> tuple[Column, Column]:
    """Own names of a formula, and those together with the row's sampled `noise`, each as `A, B`."""
    own = P.sorted_names(P.extract_predicates(formula))
    both = P.sorted_names(own, F.col("noise")) if "noise" in df.columns else own
    return P.bare_list(own), P.bare_list(both)


def _text(df: DataFrame, s: dict[str, Column], own: Column, both: Column) -> Column:
    """Instruction text of a row: head, predicate list, tail."""
    predicted = F.col("preds_pred") if "preds_pred" in df.columns else F.lit("")
    thoughts = F.coalesce("thoughts", F.lit("")) if "thoughts" in df.columns else F.lit("")
    listed = (
        F.when(s["preds_from"] == "own", P.format_bare(own, s["list_fmt"]))
        .when(s["preds_from"] == "own_noise", P.format_bare(both, s["list_fmt"]))
        .when(s["preds_from"] == "predicted", X.predicted_list(predicted, s["list_rule"]))
        .when((s["preds_from"] == "thoughts") & (thoughts != ""), F.concat(F.lit(t.EARLIER_THOUGHTS), thoughts))
        .otherwise("")  # a running context is a message of its own
    )
    return F.concat(s["head"], listed, s["tail"])


def _text_and_label(df: DataFrame, s: dict[str, Column]) -> tuple[Column, Column]:
    if "fol" not in df.columns:
        return _text(df, s, F.lit(""), F.lit("")), F.lit(None).cast("string")
    spelled = X.map_literals("fol", s["literal_map"])
    target = P.format_bare(_names(df, F.col("fol"))[0], s["list_fmt"])
    return _text(df, s, *_names(df, spelled)), X.label(spelled, s["label_kind"], target)


def _seq2seq(df: DataFrame, s: dict[str, Column]) -> DataFrame:
    text, label = _text_and_label(df, s)
    return df.select("row_id", F.concat(text, F.col("nl")).alias("nl"), label.alias("label"))


def _chat(df: DataFrame, s: dict[str, Column], train: bool = True) -> DataFrame:
    text, label = _text_and_label(df, s)
    turns = [message("system", text), message("user", F.col("nl"))]
    if train:
        turns.append(message("assistant", label))
    return df.select("row_id", F.array(*turns).alias("messages"))


def _either(df: DataFrame, family: str, setting: str, version: str, train: bool) -> DataFrame:
    s = _literal_spec(family, setting, version)
    return _seq2seq(df, s) if family == "seq2seq" else _chat(df, s, train)


def seq2seq_prompt(df: DataFrame, setting: str = "standard", version: str = "raw") -> DataFrame:
    """(row_id, nl, label): the fixed prefix in front of the sentence."""
    return _seq2seq(df, _literal_spec("seq2seq", setting, version))


def chat_train(df: DataFrame, setting: str = "standard", version: str = "raw") -> DataFrame:
    """(row_id, messages): system, user, assistant."""
    return _chat(df, _literal_spec("chat", setting, version))


def chat_infer(
    df: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = False,
    setting: str = "standard",
    version: str = "raw",
) -> DataFrame:
    """(row_id, prompt): system and user message rendered to one string."""
    chat = _chat(df, _literal_spec("chat", setting, version), train=False)
    return chat.select("row_id", render_chat("messages", template, add_generation_prompt).alias("prompt"))


def seq2seq_prompt_given_preds(df: DataFrame, version: str = "raw") -> DataFrame:
    return seq2seq_prompt(df, "gt_predicates", version)


def chat_given_preds(df: DataFrame, version: str = "raw", train: bool = True) -> DataFrame:
    return _either(df, "chat", "gt_predicates", version, train)


def prompt_with_noise(df: DataFrame, family: str, version: str = "raw", train: bool = True) -> DataFrame:
    """Prompts over own and sampled predicates; `df` carries the sampled names in `noise`."""
    return _either(df, family, "gt_predicates_noise", version, train)


def extract_task(df: DataFrame, family: str = "seq2seq", version: str = "raw") -> DataFrame:
    """First of two steps: ask for the predicates; the label is the sorted list."""
    return _either(df, family, "2step_1", version, True)


def stage2_prompt(stage1: DataFrame, family: str = "seq2seq", version: str = "raw") -> DataFrame:
    """Second step: the list cut out of the first answer (`preds_pred`) goes into the prompt."""
    return _either(stage1, family, "2step_2", version, False)


def few_shot_chat(df: DataFrame, mode: str = "none") -> DataFrame:
    """System text with worked examples; mode none, own, own_noise (needs `noise`) or reasoning."""
    setting = {
        "none": "standard",
        "own": "gt_predicates",
        "own_noise": "gt_predicates_noise",
        "reasoning": "reasoning",
    }[mode]
    return _chat(df, _literal_spec("few_shot", setting, "raw"), train=False)


def reasoning_fallback_system(thoughts) -> Column:
    """System text of the fallback request; earlier thoughts are quoted unless there are none."""
    s = _literal_spec("few_shot", "reasoning_fallback", "raw")
    thoughts = F.coalesce(X._col(thoughts), F.lit(""))
    quoted = F.when(thoughts == "", "").otherwise(F.concat(F.lit(t.EARLIER_THOUGHTS), thoughts))
    return F.concat(s["head"], quoted, s["tail"])


def drop_source_columns(df: DataFrame, family: str) -> DataFrame:
    """The chat family keeps only what was built; seq2seq keeps the sentence and formula."""
    return df.drop("nl", "fol") if family == "chat" else df


def messages_to_rows(df: DataFrame) -> DataFrame:
    """One row per chat message, with its position."""
    return df.select("row_id", F.posexplode("messages").alias("pos", "m")).select(
        "row_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def route_prompts(
    df: DataFrame, requests: list[tuple[str, str, str]], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Prompts for several (family, setting, version) requests in one pass over the corpus.

    Each row is exploded to the requested variants with what the routing table says of them: that is known
    while planning, so nothing is joined.
    """
    # What several variants share is worked out once per row, and only if some variant asks for it.
    specs = [spec(*r) for r in requests]
    wanted = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in specs])
    spellings = {s["literal_map"] for s in specs}
    listing = any(s["preds_from"] in ("own", "own_noise") or s["label_kind"] == "list" for s in specs)
    shared = {"_none": F.col("fol")}
    shared |= {f"_{m}": X.map_literals("fol", F.lit(m)) for m in spellings - {"none"}}
    for m in [m for m in list(shared) if listing]:
        shared[f"{m}_own"], shared[f"{m}_both"] = _names(df, shared[m])
    prepared = df.withColumns(shared)

    routed = prepared.withColumn("_req", F.explode(wanted)).select("*", "_req.*").drop("_req")
    s = {
        name: F.col(name)
        for name in ["head", "tail", "preds_from", "list_fmt", "list_rule", "label_kind", "literal_map"]
    }

    def chosen(suffix: str) -> Column:
        pick = F.col("_none" + suffix)
        for m in spellings - {"none"}:
            pick = F.when(s["literal_map"] == m, F.col(f"_{m}{suffix}")).otherwise(pick)
        return pick

    own, both = (chosen("_own"), chosen("_both")) if listing else (F.lit(""), F.lit(""))
    target = P.format_bare(F.col("_none_own"), s["list_fmt"]) if listing else F.lit("")
    text = _text(routed, s, own, both)
    label = X.label(chosen(""), s["label_kind"], target)
    seq2seq = F.col("family") == "seq2seq"
    return routed.select(
        "row_id",
        "family",
        "setting",
        "version",
        F.when(~seq2seq, text).alias("system"),
        F.when(seq2seq, F.concat(text, F.col("nl"))).otherwise(F.col("nl")).alias("prompt"),
        label.alias("label"),
        *keep,
    )
