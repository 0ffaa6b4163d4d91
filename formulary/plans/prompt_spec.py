"""Routing table: which text, predicate source, list format and label each task variant uses.

The table has a fixed number of rows, so joining it by broadcast is safe at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from formulary.functions.text import base_model
from formulary.plans import fixed_texts as t

COLUMNS = (
    "family string, setting string, version string, head string, tail string, preds_from string, "
    "list_fmt string, list_rule string, label_kind string, literal_map string"
)


def _seq2seq(setting, version, head, preds="none", fmt="bare", rule="", label="fol", literals="none"):
    return ("seq2seq", setting, version, head, "", preds, fmt, rule, label, literals)


def _chat(setting, version, head, tail="", preds="none", fmt="bare", rule="", label="phi_fol", literals="none"):
    return ("chat", setting, version, head, tail, preds, fmt, rule, label, literals)


def _few_shot(setting, head, tail="", preds="none", fmt="bare"):
    return ("few_shot", setting, "raw", head, tail, preds, fmt, "", "none", "none")


# The models the task variants were made for, and their family.
MODEL_FAMILIES = {
    "google-t5/t5-base": "seq2seq",
    "google-t5/t5-3b": "seq2seq",
    "google/flan-t5-xxl": "seq2seq",
    "meta-llama/Llama-3.1-8B-Instruct": "chat",
    "mistralai/Mistral-Small-24B-Instruct-2501": "chat",
    "allenai/OLMo-2-0325-32B-Instruct": "chat",
}

_PLAIN = ["standard", "multilingual", "curiculum_step3"]
_OWN = ["gt_predicates", "curiculum_step1"]
_NOISY = ["gt_predicates_noise", "curiculum_step2"]

ROWS = [
    # sequence to sequence
    *[_seq2seq(s, "utils", t.TRANSLATE, literals="words") for s in _PLAIN],
    _seq2seq("standard", "raw", t.TRANSLATE, literals="words"),
    *[_seq2seq(s, "raw", t.TRANSLATE) for s in ["multilingual", "new_tokens", "curiculum_step3"]],
    _seq2seq("new_tokens", "utils", ""),
    *[_seq2seq(s, "utils", t.TRANSLATE_USING, "own", "plain_nl", literals="words") for s in _OWN],
    *[_seq2seq(s, "utils", t.TRANSLATE_USING, "own_noise", "plain_nl", literals="words") for s in _NOISY],
    *[_seq2seq(s, "raw", t.TRANSLATE_USING, "own", "quoted") for s in _OWN],
    *[_seq2seq(s, "raw", t.TRANSLATE_USING, "own_noise", "quoted") for s in _NOISY],
    _seq2seq("2step_1", "raw", t.EXTRACT, fmt="quoted", label="list"),
    _seq2seq("2step_1", "raw_no_blank", t.EXTRACT_NO_BLANK, fmt="quoted", label="list"),
    _seq2seq("2step_2", "raw", t.TRANSLATE_USING, "predicted", rule="last_marker"),
    # chat
    *[_chat(s, "utils", t.SYSTEM_INDENTED) for s in _PLAIN],
    *[_chat(s, "raw", t.SYSTEM) for s in _PLAIN],
    _chat("new_tokens", "utils", ""),
    _chat("new_tokens", "raw", t.SYSTEM, literals="brackets"),
    *[
        _chat(s, "utils", t.SYSTEM_INDENTED_USING_HEAD, t.SYSTEM_INDENTED_USING_TAIL, p)
        for p, settings in [("own", _OWN), ("own_noise", _NOISY)]
        for s in settings
    ],
    *[
        _chat(s, "raw", t.SYSTEM_USING_HEAD, t.ANSWER, p, "quoted")
        for p, settings in [("own", _OWN), ("own_noise", _NOISY)]
        for s in settings
    ],
    _chat("2step_1", "utils", t.SYSTEM_INDENTED_EXTRACT, fmt="plain", label="list"),
    _chat("2step_1", "raw", t.SYSTEM_EXTRACT, fmt="plain", label="list"),
    _chat("2step_2", "raw", t.SYSTEM_USING_HEAD, t.ANSWER, "predicted", rule="last_line", label="none"),
    _chat("2step_2", "raw_marker", t.SYSTEM_USING_HEAD, t.ANSWER, "predicted", rule="last_marker", label="none"),
    # few-shot, remote models
    _few_shot("standard", t.FEW_SHOT),
    _few_shot("gt_predicates", t.FEW_SHOT_USING_HEAD, t.ANSWER, "own", "quoted"),
    _few_shot("gt_predicates_noise", t.FEW_SHOT_USING_HEAD, t.ANSWER, "own_noise", "quoted"),
    _few_shot("reasoning", t.FEW_SHOT_REASONING_HEAD + t.ANSWER),
    _few_shot("reasoning_fallback", t.FEW_SHOT_REASONING_HEAD, t.ANSWER, "thoughts"),
    # premise chain
    ("chain", "premises", "raw", t.CHAIN_SYSTEM, "", "context", "bare", "", "none", "none"),
]


def spec(family: str, setting: str, version: str = "raw") -> dict[str, str]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for row in ROWS:
        if row[:3] == (family, setting, version):
            return dict(zip(names, row))
    raise KeyError((family, setting, version))


def model_family(path, home: str) -> Column:
    """Family of a model named by its hub name or by a path of a tuned copy below `home`; NULL if unknown."""
    base = base_model(path, home)
    names = [F.lit(x) for pair in MODEL_FAMILIES.items() for x in pair]
    return F.try_element_at(F.create_map(*names), base)


def prompt_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, COLUMNS)
