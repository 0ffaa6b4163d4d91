import pytest
from pyspark.sql import functions as F

from formulary.operators import scoring

# prediction, truth, prediction after alignment
ALIGNED = [
    ("Cats(x)", "Cat(x)", "Cat(x)"),  # near miss
    ("Zebra(x)", "Cat(x)", "Zebra(x)"),  # nothing near
    ("Cats(x) ∧ BigCats(x)", "Cat(x) ∧ BigCats(x)", "Cat(x) ∧ BigCat(x)"),  # a name within another one
    ("abd(x) ∧ bc(x)", "abc(x) ∧ bd(x)", "aabc(x) ∧ abc(x)"),  # the second rename meets the first one's result
    ("Cats(x) ∧ Cats(y)", "Cat(x)", "Cat(x) ∧ Cat(y)"),  # repeated
    ("Dag(x)", "Dig(x) ∧ Dog(x)", "Dig(x)"),  # tie: the first of the truth
    ("Dag(x)", "Dog(x) ∧ Dig(x)", "Dog(x)"),
    ("abcde(x)", "abxyz(x)", "abxyz(x)"),  # exactly at the threshold
    ("abcde(x)", "axyzw(x)", "abcde(x)"),  # beyond it
    ("Größe(x)", "Grösse(x)", "Grösse(x)"),
    ("Cat(x)", "x = y", "Cat(x)"),  # no true predicate
    ("x = y", "Cat(x)", "x = y"),  # no predicted one
    ("", "Cat(x)", ""),
]


@pytest.mark.parametrize("pred, truth, want", ALIGNED)
def test_alignment(spark, pred, truth, want):
    df = spark.createDataFrame([(1, pred, truth)], "row_id int, fol_pred string, fol_gt string")
    assert scoring.match_predicates(df).first().aligned == want


def test_predicate_matches(spark):
    rows = [(1, "Cats(x) ∧ Zebra(y)", "Cat(x)"), (2, "Dag(x)", "Dig(x) ∧ Dog(x)"), (3, "Cat(x)", "x"), (4, "abcde(x)", "abxyz(x)")]
    df = spark.createDataFrame(rows, "row_id int, fol_pred string, fol_gt string")
    got = {(r.row_id, r.pos): (r.pred, r.best, round(r.distance, 6), r.accepted) for r in scoring.predicate_matches(df).collect()}
    assert got == {
        (1, 0): ("Cats", "Cat", 0.25, True),
        (1, 1): ("Zebra", "Cat", 1.0, False),
        (2, 0): ("Dag", "Dig", 0.333333, True),
        (4, 0): ("abcde", "abxyz", 0.6, True),
    }


def test_verdicts_and_scorecard(spark):
    gt = "∀x (Cat(x) → Animal(x))"
    rows = [
        ("m", "a", gt.replace(" ", "  ")),
        ("m", "a", "user\n𝜙=" + gt + "\n"),
        ("m", "a", gt.replace("Animal", "Animals")),
        ("m", "b", gt.replace("Animal", "Qqqqqqqq")),
        ("m", "b", "ERROR"),
        ("n", "b", None),
        ("n", "b", "(("),
    ]
    df = spark.createDataFrame(rows, "model string, setting string, fol_pred string").withColumn("fol_gt", F.lit(gt))
    judged = scoring.verdicts(df)
    assert [r.verdict for r in judged.collect()] == [
        "identical", "identical", "identical_after_match", "open", "error", "error", "open",
    ]
    from formulary.operators.formulas import parse_formulas

    cards = {(r.model, r.setting): r for r in scoring.scorecard(parse_formulas(judged, "formula")).collect()}
    top = cards[None, None]
    assert (top.n_rows, top.n_errors, top.identical_rate, top.aligned_rate) == (7, 2, round(2 / 7, 6), round(3 / 7, 6))
    assert top.level == 3 and cards["m", None].level == 1 and cards["m", "a"].level == 0
    assert cards["m", "a"].aligned_rate == 1.0 and cards["n", "b"].parse_rate == 0.0


def test_inventory(spark):
    df = spark.createDataFrame([(1, "Aa(x) ∧ Aa(y) ∧ Bb(x)"), (2, "Aa(x)"), (3, "none"), (4, None)], "row_id int, fol string")
    got = {r.pred: (r.uses, r.rows_using) for r in scoring.predicate_inventory(df).collect()}
    assert got == {"Aa": (3, 2), "Bb": (1, 1)}
