"""Column functions against the edge-case table and against Python restatements on random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from formulary.functions import predicates as P, text as X

PIECES = [
    "∀", "∃x", "∧", "⊕", "∨", "→", "↔", "¬", "(", ")", "(x)", " ", "\t", "\n", " ", "　", "\x1c", "\x85",
    "=", "𝜙=", "Cat(", "BigCat(", "Größe(", "été_2(", "_x", "foo_bar", "Predicates", "Predicates=[A]", "ß", "a", "P(",
    "FORALL", " ", "日本(",
]


def strings(n=1000, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def applied(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", make(F.col("s")).alias("o")).orderBy("i").collect()]


def test_edge_cases(spark):
    one = lambda value, make: applied(spark, [value], make)[0]
    assert one("∀x(P(x))", P.extract_predicates) == ["x", "P"]
    assert one("Größe(x) ∧ été_2(y)", P.extract_predicates) == ["Größe", "été_2"]
    assert one("FORALLx(NOTFoo(x) AND NOT(Bar(y)))", P.extract_predicates) == ["FORALLx", "NOTFoo", "NOT", "Bar"]
    assert one("  a b\t c　\n", X.remove_space) == "abc"
    assert one("𝜙=P(x)=Q(y)", X.after_last_equals) == "Q(y)"
    assert one("no preds", X.after_last_equals) == "no preds"
    assert one("no preds", lambda c: X.predicted_list(c, "last_marker")) == "s"
    assert one("foo_bar  _x y_", lambda c: X.clean_nl(c, "")) == "foo  y"
    renames = F.array(*[F.struct(F.lit("Cat").alias("old"), F.lit("BigCat").alias("new"))] * 2)
    assert one("¬Cat(x)", lambda c: P.rename_in_order(c, renames)) == "¬BigBigCat(x)"
    ids = F.array(F.lit(5), F.lit(6), F.lit(7))
    assert one("", lambda c: X.pad_truncate(ids, 8)) == [5, 6, 7, 0, 0, 0, 0, 0]
    assert one("", lambda c: X.attention_mask(ids, 8)) == [1, 1, 1, 0, 0, 0, 0, 0]
    assert one("", lambda c: X.pad_truncate(ids, 2)) == [5, 6]
    assert one("", lambda c: X.attention_mask(ids, 2)) == [1, 1]
    assert one("Größe", lambda c: F.levenshtein(c, F.lit("Grosse"))) == 3


RESTATED = {
    "extract_predicates": (P.extract_predicates, lambda s: re.findall(r"\b\w+(?=\()", s)),
    "remove_space": (X.remove_space, lambda s: re.sub(r"\s+", "", s)),
    "strip": (X.strip, str.strip),
    "words": (X.words, str.split),
    "after_last_equals": (X.after_last_equals, lambda s: s[s.rfind("=") + 1 :].strip()),
    "last_line": (lambda c: X.predicted_list(c, "last_line"), lambda s: s[s.rfind("\n") + 1 :].strip()),
    "last_marker": (lambda c: X.predicted_list(c, "last_marker"), lambda s: s[s.rfind("Predicates") :].strip()),
    "clean_nl": (
        lambda c: X.clean_nl(c, "foo"),
        lambda s: " ".join(t.split("_")[0] for t in s.replace("foo", "").split()),
    ),
    "words_form": (
        X.literals_to_words,
        lambda s: s.translate(str.maketrans(dict(zip(X.LITERALS, X.WORDS)))),
    ),
    "brackets_form": (
        X.literals_to_bracket_tokens,
        lambda s: s.translate(str.maketrans(dict(zip(X.LITERALS, X.BRACKETS)))),
    ),
    "back_from_brackets": (lambda c: X.tokens_to_literals(X.literals_to_bracket_tokens(c)), lambda s: s),
    "sorted_names": (
        lambda c: P.sorted_names(P.extract_predicates(c)),
        lambda s: sorted(set(re.findall(r"\b\w+(?=\()", s))),
    ),
}


@pytest.mark.parametrize("name", sorted(RESTATED))
def test_same_as_python(spark, name):
    column, python = RESTATED[name]
    values = strings()
    got = applied(spark, values, column)
    assert [(v, g) for v, g in zip(values, got)] == [(v, python(v)) for v in values]


def test_formats(spark):
    names = F.array(F.lit("A"), F.lit("B"))
    got = {f: applied(spark, [""], lambda c, f=f: P.format_predicates(names, f))[0] for f in ["plain", "quoted", "plain_nl", "bare"]}
    assert got == {
        "plain": "Predicates=[A, B]",
        "quoted": 'Predicates=["A, B"]\n',
        "plain_nl": "Predicates=[A, B]\n",
        "bare": "A, B",
    }


def test_base_model(spark):
    from pathlib import PurePosixPath

    def python(path, home="/hf/home"):
        try:
            return str(PurePosixPath(path).relative_to(PurePosixPath(home)).parent)
        except ValueError:
            return str(PurePosixPath(path))

    paths = [
        "/hf/home/org/model/step", "/hf/home/org", "/hf/home", "/hf/home/", "/hf/homes/org/model", "org/model", "org",
        "/hf//home/org/./model/", "./org/model", "", "/", "/hf/home/a/b/", "org//model",
    ]
    assert applied(spark, paths, lambda c: X.base_model(c, "/hf/home")) == [python(p) for p in paths]


def test_file_name_stage_label(spark):
    assert applied(spark, ['a/b:c*d?"<e>|f\\g\n'], X.safe_file_name) == ["abcdefg"]
    stages = ["curiculum_step1", "curiculum_step9", "curiculum_2", "standard", "x_step09"]
    assert applied(spark, stages, X.next_stage) == ["curiculum_step2", "curiculum_step10", "curiculum_3", None, "x_step10"]
    assert applied(spark, ["A(x)"], lambda c: X.label(c, "phi_fol")) == ["𝜙=A(x)"]


def test_words_form_back(spark):
    text = "∀x (Aa(x) ⊕ ¬Bb(x)) ∨ ∃y (Cc(y) ↔ Dd(y) → Ee(y) ∧ Ff(y))"
    assert applied(spark, [text], lambda c: X.tokens_to_literals(X.literals_to_words(c), "words")) == [text]
    with pytest.raises(ValueError):
        X.tokens_to_literals("s", "roman")
