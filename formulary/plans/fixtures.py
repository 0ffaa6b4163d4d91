"""Corpus-shaped views over the given tables.

The SELECT texts run unchanged on Spark and on the checking engine. Every view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["fol_corpus"] = """
SELECT p_partkey AS row_id,
  concat('Rule ', CAST(p_partkey AS STRING), ': every ', p_name, ' that is ', lower(p_type), ' comes from ', replace(p_brand, '#', ' '), '.') AS nl,
  CASE p_partkey % 7
    WHEN 0 THEN concat('∀x (', replace(p_name,' ','_'), '(x) → ', lower(p_type), '_part(x))')
    WHEN 1 THEN concat('∃x (', replace(p_name,' ','_'), '(x) ∧ made_by(x, ', replace(p_brand,'#',''), '))')
    WHEN 2 THEN concat('∀x (¬', lower(p_type), '_part(x) ∨ ', replace(p_name,' ','_'), '(x))')
    WHEN 3 THEN concat('∀x (', replace(p_name,' ','_'), '(x) ↔ ', lower(p_type), '_part(x))')
    WHEN 4 THEN concat('∀x∀y ((', replace(p_name,' ','_'), '(x) ∧ made_by(x, y)) → brand(y))')
    WHEN 5 THEN concat('∃x (', replace(p_name,' ','_'), '(x) ⊕ ', lower(p_type), '_part(x))')
    ELSE concat('∀x(', replace(p_name,' ','_'), '(x) → ∃y (made_by(x, y) ∧ ¬', lower(p_type), '_part(y)))')
  END AS fol,
  CASE p_partkey % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split,
  CASE p_partkey % 2 WHEN 0 THEN 'src_a' ELSE 'src_b' END AS source
FROM part"""

VIEWS["fol_predictions"] = """
SELECT row_id, run, nl,
  CASE (row_id * 5 + run) % 6
    WHEN 0 THEN fol
    WHEN 1 THEN replace(fol, ' ', '  ')
    WHEN 2 THEN replace(fol, '_part(', '_parts(')
    WHEN 3 THEN replace(fol, 'made_by(', 'zzzzzzzzzzzz(')
    WHEN 4 THEN 'ERROR'
    ELSE concat('system', chr(10), 'answer with 𝜙=', chr(10), 'assistant', chr(10), '𝜙=', fol, chr(10))
  END AS fol_pred,
  fol AS fol_gt,
  CASE run WHEN 0 THEN 'model_a' ELSE 'model_b' END AS model,
  CASE row_id % 2 WHEN 0 THEN 'standard' ELSE 'gt_predicates' END AS setting
FROM (SELECT *, 0 AS run FROM fol_corpus UNION ALL SELECT *, 1 AS run FROM fol_corpus) runs"""

VIEWS["fol_stage1"] = """
SELECT row_id, nl,
  CASE row_id % 3
    WHEN 0 THEN concat('user', chr(10), nl, chr(10), 'Predicates=[', replace(lower(source),'src','pred'), ', made_by]  ')
    WHEN 1 THEN concat('Predicates=[a, b] then Predicates=[made_by]', chr(10))
    ELSE concat('no list for row ', CAST(row_id AS STRING))
  END AS preds_pred,
  CASE row_id % 2 WHEN 0 THEN fol ELSE NULL END AS fol_gt_underscore,
  CASE row_id % 2 WHEN 1 THEN fol ELSE NULL END AS fol_gt_hyphen
FROM fol_corpus"""

VIEWS["fol_premises"] = """
SELECT CAST(floor(row_id / 4) AS BIGINT) AS example_id,
  CAST(row_id % 4 AS INT) AS idx,
  CASE row_id % 4 WHEN 3 THEN 'conclusion' ELSE 'premise' END AS kind,
  CASE WHEN row_id % 28 = 27 THEN '' ELSE nl END AS text, fol
FROM fol_corpus"""

# Results of an earlier run: everything the first model answered, and one row whose key is NULL.
VIEWS["results_done"] = """
SELECT nl, fol_pred, fol_gt FROM fol_predictions WHERE model = 'model_a' AND fol_pred <> 'ERROR'
UNION ALL SELECT CAST(NULL AS STRING) AS nl, 'ERROR' AS fol_pred, CAST(NULL AS STRING) AS fol_gt"""

# One run per user, its events in order are the epochs.
VIEWS["train_metrics"] = """
SELECT user_id AS run_id, CAST(event_id AS DOUBLE) AS epoch, value AS eval_loss FROM events"""


def _inputs(name: str) -> list[str]:
    return re.findall(r"FROM (?:\(SELECT \*, 0 AS run FROM )?(\w+)", VIEWS[name])[:1]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a base table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {table: view(spark, sf_dir, table) for table in _inputs(name)}
    text = VIEWS[name]
    for table in inputs:
        text = re.sub(rf"FROM {table}\b", f"FROM {{{table}}}", text)
    return spark.sql(text, **inputs)


def with_views(names: list[str], body: str) -> str:
    """`body` with the named views, and what they build on, inlined as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for table in _inputs(name):
                add(table)
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    lead = body.lstrip()
    if lead[:5].upper() == "WITH ":
        rest = lead[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes},\n{rest[10:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
