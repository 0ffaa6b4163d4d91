"""Prompt bytes for small inputs, and the routing table against the single operators."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from formulary.operators import prompts, sampling
from formulary.operators.prompts import ChatTemplate
from formulary.plans.prompt_spec import ROWS, spec

ROLE = (
    "You are a helpful AI assistant that translates Natural Language (NL) text in First-Order Logic (FOL) "
    "using only the given quantors and junctors:"
)
LIST = "∀ (for all), ∃ (there exists), ¬ (not), ∧ (and), ∨ (or), → (implies), ↔ (if and only if), ⊕ (xor)."
ANSWER = "Start your answer with '𝜙=' followed by the FOL-formula. Do not include any other text."


def one(spark):
    return spark.createDataFrame([(1, "Cats purr.", "∀x(Cat(x) → ¬Dog(x))")], "row_id int, nl string, fol string")


def test_seq2seq(spark):
    r = prompts.seq2seq_prompt(one(spark)).first()
    assert r.nl == "translate English natural language statements into first-order logic (FOL): Cats purr."
    assert r.label == "FORALLx(Cat(x) IMPLIES NOTDog(x))"
    head = (
        "translate English natural language statements into first-order logic (FOL) "
        "using only the following predicates:\n"
    )
    # The utils form replaces literals first, so NOT sticks to the name; the raw form does not.
    r = prompts.seq2seq_prompt_given_preds(one(spark), "utils").first()
    assert r.nl == head + "Predicates=[Cat, FORALLx, NOTDog]\nCats purr."
    r = prompts.seq2seq_prompt_given_preds(one(spark), "raw").first()
    assert r.nl == head + 'Predicates=["Cat, Dog, x"]\nCats purr.'
    assert r.label == "∀x(Cat(x) → ¬Dog(x))"
    r = prompts.extract_task(one(spark)).first()
    assert r.label == 'Predicates=["Cat, Dog, x"]\n' and r.nl.endswith("(FOL): Cats purr.")
    assert prompts.extract_task(one(spark), version="raw_no_blank").first().nl.endswith("(FOL):Cats purr.")


def test_chat(spark):
    system, user, assistant = prompts.chat_train(one(spark)).first().messages
    assert system.content == ROLE + LIST + ANSWER
    assert user == ("user", "Cats purr.") and assistant == ("assistant", "𝜙=∀x(Cat(x) → ¬Dog(x))")
    indent = "\n" + " " * 28
    system = prompts.chat_train(one(spark), version="utils").first().messages[0]
    assert system.content == ROLE + indent + LIST + indent + ANSWER
    system = prompts.chat_given_preds(one(spark), "utils").first().messages[0].content
    assert "Use only the following predicates:\"+f'Predicates=[Cat, Dog, x]\n" in system
    system = prompts.chat_given_preds(one(spark)).first().messages[0].content
    assert system == ROLE + LIST + 'Use only the following predicates:Predicates=["Cat, Dog, x"]\n' + ANSWER
    assert prompts.chat_train(one(spark), "new_tokens").first().messages[2].content == (
        "𝜙=[FOL_FORALL]x(Cat(x) [FOL_IMPLIES] [FOL_NOT]Dog(x))"
    )
    assert prompts.chat_train(one(spark), "new_tokens", "utils").first().messages[0].content == ""
    target = prompts.extract_task(one(spark), "chat").first().messages[2].content
    assert target == "Predicates=[Cat, Dog, x]"


def test_rendering(spark):
    template = ChatTemplate("<", ">", ";", "!")
    got = prompts.chat_infer(one(spark), template, add_generation_prompt=True, setting="new_tokens", version="utils")
    assert got.first().prompt == "<system>;<user>Cats purr.;!"
    assert prompts.chat_infer(one(spark), template, setting="new_tokens", version="utils").first().prompt == (
        "<system>;<user>Cats purr.;"
    )


def test_stage2(spark):
    rows = [(1, "Cats purr.", "user\nPredicates=[a] \nPredicates=[b] "), (2, "Hm.", "nothing")]
    df = spark.createDataFrame(rows, "row_id int, nl string, preds_pred string")
    got = {r.row_id: r.nl.split(":\n")[1] for r in prompts.stage2_prompt(df).collect()}
    assert got == {1: "Predicates=[b]Cats purr.", 2: "gHm."}
    chat = {r.row_id: r.messages for r in prompts.stage2_prompt(df, "chat").collect()}
    assert len(chat[1]) == 2
    assert chat[1][0].content == ROLE + LIST + "Use only the following predicates:Predicates=[b]" + ANSWER
    assert chat[2][0].content.endswith("predicates:nothing" + ANSWER)


def test_few_shot(spark):
    none = prompts.few_shot_chat(one(spark)).first().messages[0].content
    own = prompts.few_shot_chat(one(spark), "own").first().messages[0].content
    reasoning = prompts.few_shot_chat(one(spark), "reasoning").first().messages[0].content
    assert none.startswith(ROLE + "∀ (for all)") and none.endswith("Praise(z, x))))" + ANSWER)
    assert 'costs."  \n     ->𝜙=∀x∀y∀z' in none and 'costs."  \n ->𝜙=∀x∀y∀z' in own
    assert 'Praise(z, x))))Use only the following predicates:Predicates=["Cat, Dog, x"]\n' + ANSWER in own
    assert reasoning.startswith(ROLE + " ∀ (for all)") and "⊕ (xor). Here are" in reasoning
    df = spark.createDataFrame([("hmm",), ("",), (None,)], "t string")
    texts = [r.s for r in df.select(prompts.reasoning_fallback_system("t").alias("s")).collect()]
    assert "x))))Use your earlier thoughts on this: hmmStart your" in texts[0]
    assert texts[1] == texts[2] == reasoning


def test_routing_equals_the_single_operators(spark):
    corpus = one(spark).withColumn("noise", F.array(F.lit("Zebra"), F.lit("Ant")))
    requests = [r[:3] for r in ROWS if r[5] in ("none", "own", "own_noise")]
    routed = {(r.family, r.setting, r.version): r for r in prompts.route_prompts(corpus, requests).collect()}
    assert len(routed) == len(requests) == len(set(requests))
    single = []
    for family, setting, version in requests:
        if family == "seq2seq":
            made = prompts.seq2seq_prompt(corpus, setting, version)
            system, prompt, label = F.lit(None).cast("string"), F.col("nl"), F.col("label")
        elif family == "chat":
            made = prompts.chat_train(corpus, setting, version)
            system, prompt, label = (F.col("messages")[i]["content"] for i in range(3))
        else:
            continue
        key = F.lit("|".join([family, setting, version]))
        single.append(made.select(key.alias("key"), system.alias("s"), prompt.alias("p"), label.alias("l")))
    for r in reduce(DataFrame.union, single).collect():
        got = routed[tuple(r.key.split("|"))]
        assert (got.system, got.prompt, got.label) == (r.s, r.p, r.l)
    assert "Ant, Cat, Dog, Zebra, x" in routed["chat", "gt_predicates_noise", "raw"].system
    # One request asks for no list, so no list is worked out.
    plan = prompts.route_prompts(corpus, [("chat", "standard", "raw")])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_unknown_request():
    import pytest

    with pytest.raises(KeyError):
        spec("chat", "nothing")


def test_drop_source_columns(spark):
    assert prompts.drop_source_columns(one(spark), "chat").columns == ["row_id"]
    assert prompts.drop_source_columns(one(spark), "seq2seq").columns == ["row_id", "nl", "fol"]


def test_noisy_prompt(spark):
    rows = [(i, f"s{i}", f"Pred{i}(x)", "train") for i in range(20)]
    corpus = spark.createDataFrame(rows, "row_id bigint, nl string, fol string, split string")
    for r in sampling.prompt_noisy_preds(corpus, k=3).collect():
        listed = r.nl.split('["')[1].split('"]')[0].split(", ")
        assert f"Pred{r.row_id}" in listed and 3 <= len(listed) <= 4 and listed == sorted(listed)
