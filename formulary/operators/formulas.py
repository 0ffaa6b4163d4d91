"""Formulas as node tables, profiles, and prover input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from formulary import schemas
from formulary.functions import grammar, text as X
from formulary.plans import fixed_texts as t

PARSED = T.StructType(
    [
        T.StructField("parse_ok", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ambiguous_scope", T.BooleanType()),
        T.StructField("nodes", T.ArrayType(schemas.NODE)),
    ]
)


def _per_distinct(
    df: DataFrame, column: str, out: str, kind: T.DataType, work: Callable[[list[str]], pa.Array]
) -> DataFrame:
    """Adds `out` = work(df[column]). Equal strings of an Arrow batch are worked on once; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(column).dictionary_encode()
            done = work(coded.dictionary.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, done.take(coded.indices)], [*batch.schema.names, out]
            )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def _parsed(texts: list[str]) -> pa.Array:
    """PARSED values, put together column by column."""
    ok, reasons, ambiguous, ends, rows = [], [], [], [0], []
    for text in texts:
        reason = flag = None
        try:
            tree, flag = grammar.parse(text)
            rows += grammar.nodes(tree)
        except grammar.FormulaError as e:
            reason = str(e)
        ok.append(reason is None)
        reasons.append(reason)
        ambiguous.append(flag)
        ends.append(len(rows))
    columns = list(zip(*rows)) or [()] * len(schemas.NODE.fields)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schemas.NODE.fields]
    nodes = pa.StructArray.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)
    return pa.StructArray.from_arrays(
        [pa.array(ok, pa.bool_()), pa.array(reasons, pa.string()), pa.array(ambiguous, pa.bool_()), lists],
        PARSED.names,
    )


def parse_formulas(df: DataFrame, formula: str = "fol") -> DataFrame:
    """Adds parse_ok, reason, ambiguous_scope and nodes. A NULL formula does not parse."""
    out = _per_distinct(df, formula, "_p", PARSED, _parsed)
    return out.select(
        *df.columns,
        F.coalesce("_p.parse_ok", F.lit(False)).alias("parse_ok"),
        F.when(F.col("_p").isNull(), "no formula").otherwise(F.col("_p.reason")).alias("reason"),
        F.col("_p.ambiguous_scope").alias("ambiguous_scope"),
        F.coalesce("_p.nodes", F.array().cast(T.ArrayType(schemas.NODE))).alias("nodes"),
    )


def parse_nodes(df: DataFrame, formula: str = "fol") -> DataFrame:
    """One row per node; a formula that does not parse is one row with parse_ok = false and a reason."""
    parsed = parse_formulas(df.select("row_id", formula), formula)
    return parsed.select("row_id", "parse_ok", "reason", F.explode_outer("nodes").alias("n")).select(
        "row_id", "parse_ok", "reason", "n.*"
    )


def _count(keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter("nodes", keep)).cast("bigint")


def _count_kind(kind: str) -> Column:
    return _count(lambda n: n["kind"] == kind).alias(f"n_{kind}")


def formula_profile(df: DataFrame, formula: str = "fol") -> DataFrame:
    """Shape of every formula, computed from its nodes inside the row."""
    parsed = parse_formulas(df.select("row_id", formula), formula)
    kinds = ["and", "or", "xor", "implies", "iff", "not", "predicate", "constant"]
    free = F.filter("nodes", lambda n: n["free"])
    return parsed.select(
        "row_id",
        "parse_ok",
        "ambiguous_scope",
        F.size("nodes").cast("bigint").alias("n_nodes"),
        F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])), F.lit(0)).alias("depth"),
        F.coalesce(
            F.array_max(
                F.transform("nodes", lambda n: n["quantifier_depth"] + (n["kind"] == "quantified").cast("int"))
            ),
            F.lit(0),
        ).alias("quantifier_depth"),
        _count(lambda n: (n["kind"] == "quantified") & (n["symbol"] == "∀")).alias("n_forall"),
        _count(lambda n: (n["kind"] == "quantified") & (n["symbol"] == "∃")).alias("n_exists"),
        *[_count_kind(k) for k in kinds],
        F.size(
            F.array_distinct(
                F.transform(F.filter("nodes", lambda n: n["kind"] == "variable"), lambda n: n["symbol"])
            )
        ).cast("bigint").alias("n_variables"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(free, lambda n: n["symbol"]))), ",").alias(
            "free_variables"
        ),
    )


def connective_profile(df: DataFrame, formula: str = "fol") -> DataFrame:
    """Counts of the eight literals from the text alone; no parser needed."""
    return df.select("row_id", *[c.alias(n) for n, c in X.connective_counts(formula).items()])


# Fixed value: an application whose arguments contain no bracket.
FLAT_APPLICATION = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]++\([^()]*\)"


def flat_arities(df: DataFrame, formula: str = "fol") -> DataFrame:
    """(row_id, pred, arity) of applications without nested brackets, read off the text."""
    apps = F.regexp_extract_all(F.col(formula), F.lit(FLAT_APPLICATION), F.lit(0))
    found = df.select("row_id", F.explode_outer(apps).alias("app")).filter(F.col("app").isNotNull())
    inside = F.rtrim(F.substring_index("app", "(", -1), F.lit(")"))
    commas = F.length(inside) - F.length(F.replace(inside, F.lit(","), F.lit("")))
    return found.select(
        "row_id",
        F.substring_index("app", "(", 1).alias("pred"),
        F.when(X.strip(inside) == "", 0).otherwise(commas + 1).alias("arity"),
    )


def node_arities(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "predicate").select("row_id", F.col("symbol").alias("pred"), "arity")


def arity_conflicts(arities: DataFrame) -> DataFrame:
    """Predicates used with more than one argument count, with those counts and the number of uses."""
    counted = arities.groupBy("pred", "arity").agg(F.count("*").alias("uses"))
    per_pred = counted.groupBy("pred").agg(
        F.sort_array(F.collect_list("arity")).alias("arities"), F.sum("uses").alias("uses")
    )
    return per_pred.filter(F.size("arities") > 1)


def _document(premises: list[str], conclusion: str) -> str:
    write = lambda s: f"  {grammar.prover_text(grammar.parse(s)[0])}.\n"
    return (
        t.PROVER_HEADER + "".join(map(write, premises)) + t.PROVER_GOALS + write(conclusion) + t.PROVER_FOOTER
    )


def export_prover_text(examples: DataFrame) -> DataFrame:
    """(example_id, prover_input, reason): one prover input text per example row.

    Needs premises_fol and conclusion_fol. An example with an unreadable formula gets a reason instead.
    """
    kind = f"example_id {examples.schema['example_id'].dataType.simpleString()}, prover_input string, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, reasons = [], []
            for premises, conclusion in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = reason = None
                try:
                    text = _document([p or "" for p in premises or []], conclusion or "")
                except grammar.FormulaError as e:
                    reason = str(e)
                texts.append(text)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(reasons, pa.string())],
                ["example_id", "prover_input", "reason"],
            )

    return examples.select("example_id", "premises_fol", "conclusion_fol").mapInArrow(run, kind)


def write_prover_text(documents: DataFrame, path: str, one_file_each: bool = False) -> None:
    """JSON lines of (example_id, prover_input).

    one_file_each writes a text file per example, as the prover reads them: for as many examples as one
    wants files.
    """
    out = documents.filter(F.col("prover_input").isNotNull()).select("example_id", "prover_input")
    if one_file_each:
        out.write.mode("overwrite").partitionBy("example_id").text(path)
    else:
        out.write.mode("overwrite").json(path)
