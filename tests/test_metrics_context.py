import random

import pytest
from pyspark.sql import functions as F
from support import plan_of

from formulary.operators import context, metrics


def stop(losses, patience):
    best, best_at, waited = float("inf"), None, 0
    for epoch, loss in losses:
        if loss is not None and loss == loss and loss < best:
            best, best_at, waited = loss, epoch, 0
        else:
            waited += best_at is not None
            if waited >= patience:
                return epoch, best_at
    return None, best_at


def frame(spark, runs):
    rows = [(run, float(e), None if loss is None else float(loss)) for run, losses in runs.items() for e, loss in losses]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "run_id int, epoch double, eval_loss double")


def test_known_run(spark):
    losses = [5, 4, 4, 3.5, 3.6, 3.7, 3.8, 3.9, 3.0]
    df = frame(spark, {1: [(i + 1, float(x)) for i, x in enumerate(losses)]})
    r = metrics.early_stop(df, 4).first()
    assert (r.stop_epoch, r.best_epoch) == (8.0, 4.0)
    assert metrics.best_epoch(df).first().best_epoch == 9.0


@pytest.mark.parametrize("width", [1, 3, 7, 4096])
def test_early_stop_equals_a_loop(spark, width):
    rng = random.Random(width)
    runs = {}
    for run in range(60):
        epochs = sorted(rng.sample(range(1, 60), rng.randint(1, 30)))
        drift = rng.choice([-0.3, 0, 0.2])
        runs[run] = [(e, round(rng.choice([1, 2, 3]) + drift * i, 2)) for i, e in enumerate(epochs)]
    runs[99] = [(1, 2.0), (2, float("nan")), (3, None), (4, 3.0), (5, 2.0), (6, 1.0)]
    for patience in [2, 4]:
        got = {r.run_id: (r.stop_epoch, r.best_epoch) for r in metrics.early_stop(frame(spark, runs), patience, width).collect()}
        assert got == {run: stop([(float(e), x) for e, x in losses], patience) for run, losses in runs.items()}


def test_best_epoch_ties_and_gaps(spark):
    df = frame(spark, {1: [(3, 1.0), (1, 1.0), (2, float("nan"))], 2: [(1, None)]})
    got = {r.run_id: r.best_epoch for r in metrics.best_epoch(df).collect()}
    assert got == {1: 1.0, 2: None}


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_running_context(spark, monkeypatch, block):
    monkeypatch.setattr(context, "BLOCK", block)
    rows = [(c, t, f"text {c}.{t}") for c in range(4) for t in range([1, 2, 9, 23][c])]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string").repartition(3)
    for r in context.running_chat_context(df).collect():
        system, assistant, user = r.messages
        lines = [f"𝜙{j + 1} = text {r.conv_id}.{j}" for j in range(r.turn)]
        assert assistant.content == ("Previously translated premises in FOL:\n" + "\n".join(lines) if lines else "")
        assert user.content == f"text {r.conv_id}.{r.turn}" and system.role == "system"


def test_conclusion_context(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, [])], "example_id int, premises_fol array<string>")
    got = {r.example_id: r.context for r in context.conclusion_context(df).collect()}
    head = "Previously translated premises in FOL:\n"
    assert got == {1: head + "𝜙1 = A\n𝜙2 = B", 2: head}


def test_long_conversation_and_its_plan(spark):
    turns = spark.range(10_000).selectExpr("1L AS conv_id", "CAST(id AS INT) AS turn", "concat('t', id) AS text")
    out = context.running_chat_context(turns)
    last = out.filter("turn = 9999").first().messages[1]["content"].split("\n")
    assert last[-1].endswith("9999 = t9998") and len([x for x in last if " = t" in x]) == 9999
    windows = [line for line in plan_of(out).splitlines() if "Window" in line and "_lines" in line]
    assert not windows  # texts are never ordered over a whole conversation


def test_short_groups_pay_one_exchange(spark):
    turns = spark.range(3_000).selectExpr("id div 5 AS conv_id", "CAST(id % 5 AS INT) AS turn", "concat('t', id) AS text")
    plan = plan_of(context.running_chat_context(turns)).split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_long_and_short_groups_with_gaps(spark):
    """Positions with holes and below zero; groups of one and of several blocks side by side."""
    rows = [("long", 7 * i - 900, f"l{i}") for i in range(400)] + [(f"s{k}", 3 * i, f"{k}.{i}") for k in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "example_id string, idx int, fol string").withColumn("kind", F.lit("premise"))
    got = {(r.example_id, r.idx): r.context for r in context.premise_context(df.repartition(4)).collect()}
    for g in ("long", "s0", "s4"):
        mine = [r for r in rows if r[0] == g]
        for k, r in enumerate(mine):
            assert got[r[:2]] == "\n".join(f"𝜙{j + 1} = {mine[j][2]}" for j in range(k))
