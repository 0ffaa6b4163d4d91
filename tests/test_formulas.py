import pytest
from pyspark.sql import functions as F

from formulary.functions import grammar
from formulary.operators import formulas

# formula, tree written out, whether the reach of a quantifier is ambiguous
SUITE = [
    ("Cat(x)", "Cat(x)", False),
    ("¬Cat(x)", "¬Cat(x)", False),
    ("Aa(x) → Bb(x) → Cc(x)", "(Aa(x) → (Bb(x) → Cc(x)))", False),
    ("Aa(x) ∧ Bb(x) ∧ Cc(x)", "(Aa(x) ∧ (Bb(x) ∧ Cc(x)))", False),
    ("Aa(x) ∧ Bb(x) ∨ Cc(x)", "(Aa(x) ∧ (Bb(x) ∨ Cc(x)))", False),
    ("Aa(x) ∨ Bb(x) ∧ Cc(x)", "((Aa(x) ∨ Bb(x)) ∧ Cc(x))", False),
    ("Aa(x) ⊕ Bb(x) ↔ Cc(x) → Dd(x)", "(((Aa(x) ⊕ Bb(x)) ↔ Cc(x)) → Dd(x))", False),
    ("Aa(x) → Bb(x) ↔ Cc(x) ⊕ Dd(x)", "(Aa(x) → (Bb(x) ↔ (Cc(x) ⊕ Dd(x))))", False),
    ("Aa(x) ∧ Bb(x) ⊕ Cc(x)", "((Aa(x) ∧ Bb(x)) ⊕ Cc(x))", False),
    ("¬Aa(x) ∨ Bb(x)", "(¬Aa(x) ∨ Bb(x))", False),
    ("¬(Aa(x) ∨ Bb(x))", "¬(Aa(x) ∨ Bb(x))", False),
    ("∀x (Aa(x) → Bb(x))", "∀x (Aa(x) → Bb(x))", False),
    ("∀x Aa(x) → Bb(x)", "∀x (Aa(x) → Bb(x))", True),
    ("∀x (Aa(x)) ∧ Bb(y)", "∀x (Aa(x) ∧ Bb(y))", True),
    ("(∀x Aa(x)) ∧ Bb(y)", "(∀x Aa(x) ∧ Bb(y))", False),
    ("Cc(y) ∧ ∃x Aa(x) ∨ Bb(x)", "(Cc(y) ∧ ∃x (Aa(x) ∨ Bb(x)))", True),
    ("∀x∃y∀z Rel(x, y, z)", "∀x ∃y ∀z Rel(x,y,z)", False),
    ("∀xCat(x)", "∀x Cat(x)", False),
    ("Größe(tom) ∧ été_2(x)", "(Größe(tom) ∧ été_2(x))", False),
    ("Rel(x,New-York,'q')", "Rel(x,New-York,'q')", False),
    ("  Cat( x ,y )  ", "Cat(x,y)", False),
    ("Holds()", "Holds()", False),
    ("Aa(Bb(x) ∧ Cc(y), z)", "Aa((Bb(x) ∧ Cc(y)),z)", False),
    ("constant", "constant", False),
]
BROKEN = ["", "(", "Cat(x", "Cat(x))", "P(x)", "∀ Cat(x)", "∀X Cat(X)", "Cat(x) ∧", "∧ Cat(x)", "Cat(x,)", "Aa(x) Bb(x)", "x (y)", ","]


def written(tree):
    kind, symbol, kids = tree
    if kind in ("variable", "constant"):
        return symbol
    if kind == "predicate":
        return f"{symbol}({','.join(map(written, kids))})"
    if kind == "quantified":
        return f"{symbol}{kids[0][1]} {written(kids[1])}"
    if kind == "not":
        return "¬" + written(kids[0])
    return f"({written(kids[0])} {symbol} {written(kids[1])})"


@pytest.mark.parametrize("text,tree,ambiguous", SUITE)
def test_reading(text, tree, ambiguous):
    got, flag = grammar.parse(text)
    assert (written(got), flag) == (tree, ambiguous)


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    with pytest.raises(grammar.FormulaError):
        grammar.parse(text)


def test_deep_nesting():
    deep = "(" * 12_000 + "Cat(x)" + ")" * 12_000
    assert written(grammar.parse(deep)[0]) == "Cat(x)"
    tree = grammar.parse("¬" * 25_000 + "Cat(x)")[0]
    assert len(grammar.nodes(tree)) == 25_002 and grammar.prover_text(tree) == "-" * 25_000 + "Cat(x)"
    tree = grammar.parse("∀x " * 2_000 + "Cat(x)")[0]
    assert grammar.nodes(tree)[-1][6] == 2_000
    tree, _ = grammar.parse(" → ".join(f"Cat{i}(x)" for i in range(3_000)))
    assert tree[0] == "implies" and tree[2][0][1] == "Cat0"
    with pytest.raises(grammar.FormulaError):
        grammar.parse("(" * 12_000 + "Cat(x)")



def test_parse_columns(spark):
    rows = [(0, "Cat(x)"), (1, "Cat("), (2, None), (3, "∀x Aa(x) → Bb(y)"), (4, "Cat(x)")]
    df = spark.createDataFrame(rows, "row_id int, fol string").coalesce(1)
    got = {r.row_id: r for r in formulas.parse_formulas(df).collect()}
    assert [got[i].parse_ok for i in range(5)] == [True, False, False, True, True]
    assert got[1].reason == "unexpected end" and got[2].reason == "no formula" and got[0].reason is None
    assert got[0].nodes == got[4].nodes and len(got[0].nodes) == 2 and got[3].ambiguous_scope
    nodes = formulas.parse_nodes(df).collect()
    assert sum(r.row_id == 3 for r in nodes) == 7 and sum(r.row_id == 1 for r in nodes) == 1
    free = {(r.symbol, r.free) for r in nodes if r.row_id == 3 and r.kind == "variable"}
    assert free == {("x", False), ("y", True)}


def test_profile(spark):
    df = spark.createDataFrame([(1, "∀x (Aa(x) → ∃y (Rel(x, y, tom) ∧ ¬Aa(z)))"), (2, "((")], "row_id int, fol string")
    got = {r.row_id: r for r in formulas.formula_profile(df).collect()}
    r = got[1]
    assert (r.n_nodes, r.depth, r.quantifier_depth, r.n_forall, r.n_exists) == (15, 6, 2, 1, 1)
    assert (r.n_and, r.n_or, r.n_implies, r.n_not, r.n_predicate, r.n_constant) == (1, 0, 1, 1, 3, 1)
    assert (r.n_variables, r.free_variables) == (3, "z")
    assert not got[2].parse_ok and got[2].n_nodes == 0 and got[2].depth == 0


def test_scope_of_rebound_variables(spark):
    df = spark.createDataFrame([(1, "(∀x Aa(x)) ∧ Bb(x)")], "row_id int, fol string")
    assert formulas.formula_profile(df).first().free_variables == "x"


def test_arities(spark):
    rows = [(1, "Aa(x) ∧ Aa(x, y)"), (2, "Bb(x) ∧ Holds()"), (3, "Holds(x) ∧ Bb(y)"), (4, "Bb(Aa(x))")]
    df = spark.createDataFrame(rows, "row_id int, fol string")
    nodes = {r.pred: (r.arities, r.uses) for r in formulas.arity_conflicts(formulas.node_arities(formulas.parse_nodes(df))).collect()}
    assert nodes == {"Aa": ([1, 2], 3), "Holds": ([0, 1], 2)}
    flat = {r.pred: r.arities for r in formulas.arity_conflicts(formulas.flat_arities(df)).collect()}
    assert flat == {"Aa": [1, 2], "Holds": [0, 1]}


PROVER = [
    ("∀x (Cat(x) → Animal(x))", "all x ((Cat(x) -> Animal(x)))"),
    ("∃x (Aa(x) ⊕ Bb(x))", "exists x (((Aa(x) | Bb(x)) & -(Aa(x) & Bb(x))))"),
    ("¬Aa(tom) ∨ Bb(\"Tim\")", "(-Aa(tom) | Bb(Tim))"),
    ("Aa(x) ↔ Holds()", "(Aa(x) <-> Holds)"),
    ("Aa(x) ∧ Bb(x) ∧ Cc(x)", "(Aa(x) & (Bb(x) & Cc(x)))"),
]


def test_prover_input(spark, tmp_path):
    for text, want in PROVER:
        assert grammar.prover_text(grammar.parse(text)[0]) == want
    df = spark.createDataFrame(
        [(1, [PROVER[0][0], "Cat(tom)"], "Animal(tom)"), (2, ["Cat("], "Cat(tom)"), (3, [], "Cat(tom)")],
        "example_id bigint, premises_fol array<string>, conclusion_fol string",
    )
    docs = formulas.export_prover_text(df)
    got = {r.example_id: r for r in docs.collect()}
    assert got[1].prover_input == "\n".join(
        [
            "set(prolog_style_variables).", "set(auto_denials).", "clear(print_initial_clauses).",
            "clear(print_kept).", "clear(print_given).", "", "formulas(assumptions).",
            "  all x ((Cat(x) -> Animal(x))).", "  Cat(tom).", "end_of_list.", "", "formulas(goals).",
            "  Animal(tom).", "end_of_list.",
        ]
    )
    assert got[2].prover_input is None and got[2].reason == "unexpected end"
    assert "formulas(assumptions).\nend_of_list." in got[3].prover_input
    formulas.write_prover_text(docs, str(tmp_path / "table"))
    assert spark.read.json(str(tmp_path / "table")).count() == 2
    formulas.write_prover_text(docs, str(tmp_path / "out"), one_file_each=True)
    [file] = (tmp_path / "out" / "example_id=1").glob("*.txt")
    assert file.read_text().rstrip("\n") == got[1].prover_input


def test_connectives(spark):
    df = spark.createDataFrame([(1, "∀x∀y (Aa(x) ∧ Bb(y)) → ¬¬Cc(x)")], "row_id int, fol string")
    r = formulas.connective_profile(df).first()
    assert (r.n_forall, r.n_and, r.n_implies, r.n_not, r.n_xor) == (2, 1, 1, 2, 0)


def test_equal_formulas_are_read_once_per_batch(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.lit("Cat(x)").alias("fol"))
    assert formulas.parse_formulas(df).filter("parse_ok and size(nodes) = 2").count() == 50
