"""SQL for the checking engine: what each registered query must return, written without its operators."""

from __future__ import annotations

from formulary.plans import fixed_texts as t
from formulary.plans.catalog import BATCH, FIXED_LENGTH, LABELS, TRAINING_LENGTH, VOCAB_SIZE
from formulary.plans.fixtures import with_views
from formulary.plans.prompt_spec import COLUMNS, ROWS

ORACLE: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
LITERALS = [
    ("∀", "FORALL"),
    ("∃", "EXISTS"),
    ("∧", "AND"),
    ("⊕", "XOR"),
    ("∨", "OR"),
    ("→", "IMPLIES"),
    ("↔", "IFF"),
    ("¬", "NOT"),
]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def add(name: str, body: str, *views: str) -> None:
    ORACLE[name] = with_views(list(views), body)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def preds(x: str) -> str:
    return rf"regexp_extract_all({x}, '([\p{{L}}\p{{N}}_]+)\(', 1)"


def names(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ', ')"


def swap(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


def to_words(x: str) -> str:
    return swap(x, LITERALS)


def to_brackets(x: str) -> str:
    return swap(x, [(a, f"[FOL_{b}]") for a, b in LITERALS])


def formatted(listed: str, fmt: str) -> str:
    return {
        "bare": listed,
        "plain": f"concat('Predicates=[', {listed}, ']')",
        "plain_nl": f"concat('Predicates=[', {listed}, ']', chr(10))",
        "quoted": f"concat('Predicates=[\"', {listed}, '\"]', chr(10))",
    }[fmt]


def last_equals(x: str) -> str:
    return strip(f"string_split({x}, '=')[-1]")


def cut_list(x: str, rule: str) -> str:
    if rule == "last_line":
        return strip(f"string_split({x}, chr(10))[-1]")
    return strip(
        f"CASE WHEN contains({x}, 'Predicates') THEN concat('Predicates', string_split({x}, 'Predicates')[-1]) "
        f"ELSE right({x}, 1) END"
    )


def messages(source: str, *turns: tuple[str, str], keys: str = "row_id") -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keys}, {i} AS pos, '{role}' AS role, {content} AS content FROM {source}"
        for i, (role, content) in enumerate(turns)
    )


# -- sources and sinks -----------------------------------------------------------------------------

EXAMPLES = f"""ex AS (
  SELECT example_id, {LABELS} AS label,
    coalesce(string_agg(text, '|' ORDER BY idx) FILTER (kind = 'premise'), '') AS premises,
    coalesce(string_agg(fol, '|' ORDER BY idx) FILTER (kind = 'premise'), '') AS premises_fol,
    coalesce(max(text) FILTER (kind = 'conclusion'), '') AS conclusion,
    coalesce(max(fol) FILTER (kind = 'conclusion'), '') AS conclusion_fol
  FROM fol_premises GROUP BY example_id)"""

add("read_pairs_json", "SELECT nl, fol FROM fol_corpus", "fol_corpus")
add("read_examples_jsonl", f"WITH {EXAMPLES} SELECT premises, conclusion, label FROM ex", "fol_premises")
add("read_split", "SELECT row_id, nl, fol, split FROM fol_corpus WHERE split = 'val'", "fol_corpus")
add("training_languages", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'en')")
add(
    "write_predictions",
    "SELECT row_id, nl, fol_pred, fol_gt, concat('org', model) AS model, setting FROM fol_predictions",
    "fol_predictions",
)
add(
    "write_examples_jsonl",
    f"WITH {EXAMPLES} SELECT premises_fol, conclusion_fol, conclusion, label FROM ex",
    "fol_premises",
)
add(
    "append_progress",
    "SELECT row_id, run, fol_pred, CAST(run AS BIGINT) AS batch_id FROM fol_predictions",
    "fol_predictions",
)

# -- prompts ---------------------------------------------------------------------------------------

OWN = names(preds("fol"))

add(
    "seq2seq_prompt",
    f"SELECT row_id, concat({lit(t.TRANSLATE)}, nl) AS nl, {to_words('fol')} AS label FROM fol_corpus",
    "fol_corpus",
)
add(
    "chat_train",
    messages("fol_corpus", ("system", lit(t.SYSTEM)), ("user", "nl"), ("assistant", "concat('𝜙=', fol)")),
    "fol_corpus",
)
add(
    "chat_infer",
    f"SELECT row_id, concat('<|system|>', chr(10), {lit(t.SYSTEM)}, chr(10), '<|user|>', chr(10), nl, chr(10), "
    "'<|assistant|>', chr(10)) AS prompt FROM fol_corpus",
    "fol_corpus",
)
add(
    "seq2seq_prompt_given_preds",
    f"WITH w AS (SELECT row_id, nl, {to_words('fol')} AS fol FROM fol_corpus) "
    f"SELECT row_id, concat({lit(t.TRANSLATE_USING)}, {formatted(OWN, 'plain_nl')}, nl) AS nl, fol AS label FROM w",
    "fol_corpus",
)
_USING = f"concat({lit(t.SYSTEM_USING_HEAD)}, {formatted(OWN, 'quoted')}, {lit(t.ANSWER)})"
add(
    "chat_given_preds",
    messages("fol_corpus", ("system", _USING), ("user", "nl"), ("assistant", "concat('𝜙=', fol)")),
    "fol_corpus",
)

# 60 bits of md5 per draw; 10 draws, then the positions after the first one.
NOISE = f"""
  indexed AS (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS idx,
      count(*) OVER (PARTITION BY split) AS n FROM fol_corpus),
  hashed AS (
    SELECT row_id, split, n, 2 * i + h AS ord,
      CAST('0x' || substr(md5(concat(CAST(row_id AS VARCHAR), ':0:', CAST(i AS VARCHAR))), 1 + 16 * h, 15) AS BIGINT) % n AS idx
    FROM indexed, (SELECT unnest(range(5)) AS i) r, (SELECT unnest(range(2)) AS h) s),
  spread AS (
    SELECT row_id, split, n, ord, idx FROM hashed
    UNION ALL
    SELECT row_id, split, n, 9 + i, (idx + i) % n FROM hashed, (SELECT unnest(range(1, 6)) AS i) r WHERE ord = 0),
  firsts AS (SELECT row_id, split, n, idx, min(ord) AS ord FROM spread GROUP BY ALL),
  drawn AS (
    SELECT row_id, split, idx FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ord) AS rn FROM firsts) f WHERE rn <= 5),
  noise AS (
    SELECT d.row_id, p.row_id AS peer_id, {preds('p.fol')} AS preds
    FROM drawn d JOIN indexed p ON d.split = p.split AND d.idx = p.idx),
  noise_set AS (
    SELECT row_id, list_sort(list_distinct(flatten(list(preds)))) AS noise FROM noise GROUP BY row_id),
  with_noise AS (SELECT c.*, noise FROM fol_corpus c JOIN noise_set s ON c.row_id = s.row_id)"""
BOTH = names(f"list_concat({preds('fol')}, noise)")

add(
    "prompt_noisy_preds",
    f"WITH {NOISE} SELECT row_id, concat({lit(t.TRANSLATE_USING)}, {formatted(BOTH, 'quoted')}, nl) AS nl, "
    "fol AS label FROM with_noise",
    "fol_corpus",
)
_NOISY = f"concat({lit(t.SYSTEM_INDENTED_USING_HEAD)}, {BOTH}, {lit(t.SYSTEM_INDENTED_USING_TAIL)})"
add(
    "chat_noisy_preds",
    f"WITH {NOISE} "
    + messages("with_noise", ("system", _NOISY), ("user", "nl"), ("assistant", "concat('𝜙=', fol)")),
    "fol_corpus",
)
add(
    "extract_task",
    f"SELECT row_id, concat({lit(t.EXTRACT)}, nl) AS nl, {formatted(OWN, 'quoted')} AS label FROM fol_corpus",
    "fol_corpus",
)
add(
    "stage2_prompt",
    f"SELECT row_id, concat({lit(t.TRANSLATE_USING)}, {cut_list('preds_pred', 'last_marker')}, nl) AS nl FROM fol_stage1",
    "fol_stage1",
)
_STAGE2 = f"concat({lit(t.SYSTEM_USING_HEAD)}, {cut_list('preds_pred', 'last_line')}, {lit(t.ANSWER)})"
add("stage2_chat", messages("fol_stage1", ("system", _STAGE2), ("user", "nl")), "fol_stage1")
_SHOTS = f"concat({lit(t.FEW_SHOT_USING_HEAD)}, {formatted(OWN, 'quoted')}, {lit(t.ANSWER)})"
add("few_shot_chat", messages("fol_corpus", ("system", _SHOTS), ("user", "nl")), "fol_corpus")
add(
    "drop_source_columns",
    "SELECT row_id, split, source, concat('𝜙=', fol) AS label FROM fol_corpus",
    "fol_corpus",
)


def _routed(row: tuple) -> str:
    s = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], row))
    fol = {"words": to_words("fol"), "brackets": to_brackets("fol"), "none": "fol"}[s["literal_map"]]
    own = preds(fol)
    listed = {
        "none": "''",
        "own": formatted(names(own), s["list_fmt"]),
        "own_noise": formatted(names(f"list_concat({own}, noise)"), s["list_fmt"]),
    }[s["preds_from"]]
    text = f"concat({lit(s['head'])}, {listed}, {lit(s['tail'])})"
    label = {
        "fol": fol,
        "phi_fol": f"concat('𝜙=', {fol})",
        "list": formatted(OWN, s["list_fmt"]),
        "none": "CAST(NULL AS VARCHAR)",
    }[s["label_kind"]]
    one_text = s["family"] == "seq2seq"
    return (
        f"SELECT row_id, '{s['family']}' AS family, '{s['setting']}' AS setting, '{s['version']}' AS version, "
        f"{'CAST(NULL AS VARCHAR)' if one_text else text} AS system, "
        f"{f'concat({text}, nl)' if one_text else 'nl'} AS prompt, {label} AS label FROM with_noise"
    )


add(
    "route_prompts",
    f"WITH {NOISE} " + "\nUNION ALL ".join(_routed(r) for r in ROWS if r[5] in ("none", "own", "own_noise")),
    "fol_corpus",
)
# Stated one by one, without the routing table.
_NO_TEXT = "CAST(NULL AS VARCHAR)"
_GIVEN = [
    ("seq2seq", "2step_2", "raw", _NO_TEXT, f"concat({lit(t.TRANSLATE_USING)}, {cut_list('preds_pred', 'last_marker')}, c.nl)", "c.fol"),
    ("chat", "2step_2", "raw", f"concat({lit(t.SYSTEM_USING_HEAD)}, {cut_list('preds_pred', 'last_line')}, {lit(t.ANSWER)})", "c.nl", _NO_TEXT),
    ("chat", "2step_2", "raw_marker", f"concat({lit(t.SYSTEM_USING_HEAD)}, {cut_list('preds_pred', 'last_marker')}, {lit(t.ANSWER)})", "c.nl", _NO_TEXT),
    (
        "few_shot",
        "reasoning_fallback",
        "raw",
        f"concat({lit(t.FEW_SHOT_REASONING_HEAD)}, CASE WHEN c.row_id % 2 = 1 THEN concat({lit(t.EARLIER_THOUGHTS)}, 'I think ', c.nl) "
        f"ELSE '' END, {lit(t.ANSWER)})",
        "c.nl",
        _NO_TEXT,
    ),
    ("chain", "premises", "raw", lit(t.CHAIN_SYSTEM), "c.nl", _NO_TEXT),
]
add(
    "route_prompts_given",
    "\nUNION ALL ".join(
        f"SELECT c.row_id, '{f}' AS family, '{s}' AS setting, '{v}' AS version, {system} AS system, {prompt} AS prompt, {label} AS label "
        "FROM fol_corpus c JOIN fol_stage1 s ON c.row_id = s.row_id"
        for f, s, v, system, prompt, label in _GIVEN
    ),
    "fol_corpus",
    "fol_stage1",
)
add(
    "nonempty_conclusions",
    "SELECT example_id, text AS conclusion FROM fol_premises WHERE kind = 'conclusion' AND text <> ''",
    "fol_premises",
)
add(
    "errors_to_requeue",
    "SELECT row_id, run, nl FROM fol_predictions WHERE fol_pred = 'ERROR'",
    "fol_predictions",
)
_NULL = "CAST(NULL AS VARCHAR)"
add(
    "harmonise_results",
    f"SELECT row_id, nl, {_NULL} AS prompt, {_NULL} AS fol_pred, coalesce(fol_gt_underscore, fol_gt_hyphen) AS fol_gt, "
    f"preds_pred, {_NULL} AS preds_gt, {_NULL} AS reasoning, CAST(NULL AS BOOLEAN) AS fallback_used FROM fol_stage1",
    "fol_stage1",
)

_STORED = {  # what each stored variant keeps
    "seq2seq": ["nl", "fol_pred", "fol_gt"],
    "chat": ["prompt", "fol_pred"],
    "raw": ["nl", "fol_pred", "fol_gt"],
    "first_step": ["nl", "preds_pred", "preds_gt", "fol_gt"],
    "first_step_hyphen": ["nl", "preds_pred", "preds_gt", "fol_gt"],
    "second_step": ["nl", "fol_pred", "preds_pred", "preds_gt", "fol_gt"],
    "second_step_hyphen": ["nl", "fol_pred", "preds_pred", "preds_gt", "fol_gt"],
    "remote": ["nl", "fol_pred", "fol_gt", "reasoning", "fallback_used"],
}
_RESULT_COLUMNS = ["nl", "prompt", "fol_pred", "fol_gt", "preds_pred", "preds_gt", "reasoning"]
add(
    "result_files",
    f"WITH r AS (SELECT nl, concat('Q: ', nl) AS prompt, fol_pred, fol_gt, {names(preds('fol_pred'))} AS preds_pred, "
    f"{names(preds('fol_gt'))} AS preds_gt, concat('because ', model) AS reasoning, run = 1 AS fallback_used "
    "FROM fol_predictions) "
    + " UNION ALL ".join(
        f"SELECT '{variant}' AS variant, "
        + ", ".join(c if c in kept else f"{_NULL} AS {c}" for c in _RESULT_COLUMNS)
        + (", fallback_used" if "fallback_used" in kept else ", CAST(NULL AS BOOLEAN) AS fallback_used")
        + " FROM r"
        for variant, kept in _STORED.items()
    ),
    "fol_predictions",
)

# -- joins and sets --------------------------------------------------------------------------------

for _name in ("pending", "pending_bucketed"):
    add(
        _name,
        "SELECT row_id, nl FROM fol_corpus c WHERE NOT EXISTS "
        "(SELECT 1 FROM results_done d WHERE d.nl IS NOT DISTINCT FROM c.nl)",
        "fol_corpus",
        "results_done",
    )
add(
    "noise_rows",
    f"WITH {NOISE} SELECT row_id, peer_id, array_to_string(preds, ',') AS preds FROM noise",
    "fol_corpus",
)

# Nearest true predicate per predicted one, and the renames applied one after the other.
def matching(formula: str, source: str = "fol_predictions") -> str:
    return f"""
  lists AS (
    SELECT row_id, run, {formula} AS formula, fol_gt, {preds(formula)} AS l1, {preds('fol_gt')} AS l2 FROM {source}),
  p1 AS (SELECT row_id, run, unnest(l1) AS a, generate_subscripts(l1, 1) AS i FROM lists),
  p2 AS (SELECT row_id, run, unnest(l2) AS b, generate_subscripts(l2, 1) AS k FROM lists),
  scored AS (
    SELECT p1.row_id, p1.run, i, a, b, k, levenshtein(a, b) / greatest(length(a), length(b)) AS d
    FROM p1 JOIN p2 ON p1.row_id = p2.row_id AND p1.run = p2.run),
  near AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, run, i ORDER BY d, k) AS rn FROM scored) s
    WHERE rn = 1),
  renames AS (SELECT row_id, run, i, a, CASE WHEN d <= 0.6 THEN b ELSE a END AS z FROM near),
  fold AS (
    SELECT row_id, run, CAST(0 AS BIGINT) AS i, formula AS acc FROM lists
    UNION ALL
    SELECT f.row_id, f.run, f.i + 1, replace(f.acc, concat(m.a, '('), concat(m.z, '('))
    FROM fold f JOIN renames m ON m.row_id = f.row_id AND m.run = f.run AND m.i = f.i + 1),
  aligned AS (SELECT row_id, run, arg_max(acc, i) AS aligned FROM fold GROUP BY row_id, run),
  judged AS (
    SELECT p.row_id, p.run, p.model, p.setting, l.formula, a.aligned,
      CASE WHEN p.fol_pred = 'ERROR' THEN 'error'
        WHEN {bare('l.formula')} = {bare('l.fol_gt')} THEN 'identical'
        WHEN {bare('a.aligned')} = {bare('l.fol_gt')} THEN 'identical_after_match'
        ELSE 'open' END AS verdict
    FROM fol_predictions p JOIN lists l ON p.row_id = l.row_id AND p.run = l.run
    JOIN aligned a ON p.row_id = a.row_id AND p.run = a.run)"""


RAW_MATCH, CLEAN_MATCH = matching("fol_pred"), matching(last_equals("fol_pred"))

add(
    "predicate_matches",
    f"WITH RECURSIVE {RAW_MATCH} SELECT row_id, run, i - 1 AS pos, a AS pred, b AS best, round(d, 6) AS distance, "
    "d <= 0.6 AS accepted FROM near",
    "fol_predictions",
)
add(
    "attach_predictions",
    "SELECT c.row_id, c.nl, p.run, p.fol_pred FROM fol_corpus c JOIN fol_predictions p ON c.row_id = p.row_id",
    "fol_corpus",
    "fol_predictions",
)
add(
    "chain_stages",
    "SELECT s.row_id, s.preds_pred, c.nl, c.fol FROM fol_stage1 s JOIN fol_corpus c ON s.row_id = c.row_id",
    "fol_stage1",
)
add(
    "union_predicates",
    f"SELECT row_id, run, array_to_string(list_sort(list_distinct(list_concat({preds('fol_gt')}, {preds('fol_pred')}))), ',') "
    "AS preds FROM fol_predictions",
    "fol_predictions",
)
add(
    "merge_results",
    "SELECT nl, fol_pred, fol_gt, CAST(NULL AS BOOLEAN) AS fallback_used FROM results_done UNION ALL "
    f"SELECT nl, fol_pred, {_NULL}, true FROM fol_predictions",
    "results_done",
)
_TWO = (
    "both_sources AS (SELECT row_id, nl, fol, 'a' AS source FROM fol_corpus UNION ALL "
    "SELECT row_id, nl, fol_pred, 'b' FROM fol_predictions)"
)
add("combine_corpora", f"WITH {_TWO} SELECT row_id, nl, fol, source FROM both_sources", "fol_predictions")
add(
    "combine_corpora_dedup",
    f"WITH {_TWO} SELECT row_id, nl, fol, source FROM (SELECT *, row_number() OVER "
    "(PARTITION BY nl, fol ORDER BY source, row_id) AS rn FROM both_sources) r WHERE rn = 1",
    "fol_predictions",
)

# -- aggregations and windows ----------------------------------------------------------------------

add(
    "predicate_inventory",
    f"SELECT pred, count(*) AS uses, count(DISTINCT row_id) AS rows_using FROM "
    f"(SELECT row_id, unnest({preds('fol')}) AS pred FROM fol_corpus) u GROUP BY pred",
    "fol_corpus",
)
add(
    "noise_predicate_set",
    f"WITH {NOISE} SELECT row_id, array_to_string(noise, ',') AS noise FROM noise_set",
    "fol_corpus",
)
add(
    "progress",
    f"SELECT model, setting, (SELECT count(*) FROM fol_corpus) AS total, count(*) AS done, "
    f"CAST(ceil((SELECT count(*) FROM fol_corpus) / {BATCH}.0) AS BIGINT) AS batches, "
    f"CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS batches_done FROM fol_predictions GROUP BY model, setting",
    "fol_corpus",
    "fol_predictions",
)
add(
    "progress_of_runs",
    f"{ORACLE['progress']} UNION ALL SELECT 'model_c', 'standard', (SELECT count(*) FROM fol_corpus), 0, "
    f"CAST(ceil((SELECT count(*) FROM fol_corpus) / {BATCH}.0) AS BIGINT), 0",
)
add(
    "best_epoch",
    "SELECT run_id, epoch AS best_epoch, eval_loss AS best_loss FROM (SELECT *, row_number() OVER "
    "(PARTITION BY run_id ORDER BY eval_loss, epoch) AS rn FROM train_metrics) m WHERE rn = 1",
    "train_metrics",
)
add(
    "early_stop",
    """WITH p AS (
    SELECT *, row_number() OVER w AS pos, coalesce(eval_loss < min(eval_loss) OVER
      (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
    FROM train_metrics WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
  q AS (
    SELECT *, max(CASE WHEN better THEN pos END) OVER (PARTITION BY run_id ORDER BY epoch) AS last_pos,
      max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS last_epoch FROM p)
  SELECT run_id, min(epoch) FILTER (pos - last_pos >= 4) AS stop_epoch,
    coalesce(arg_min(last_epoch, pos) FILTER (pos - last_pos >= 4), max(last_epoch)) AS best_epoch
  FROM q GROUP BY run_id""",
    "train_metrics",
)
add(
    "scorecard",
    f"""WITH RECURSIVE {CLEAN_MATCH}
  SELECT model, setting, CAST(grouping(model, setting) AS BIGINT) AS level, count(*) AS n_rows,
    count(*) FILTER (verdict = 'error') AS n_errors,
    round(count(*) FILTER (verdict = 'identical') / count(*), 6) AS identical_rate,
    round(count(*) FILTER (verdict IN ('identical', 'identical_after_match')) / count(*), 6) AS aligned_rate
  FROM judged GROUP BY ROLLUP (model, setting)""",
    "fol_predictions",
)
# All sent answers are well-formed by construction; the bare word ERROR counts as not parsed.
add(
    "scorecard_with_parse",
    ORACLE["scorecard"].replace(
        "AS aligned_rate", "AS aligned_rate, round(count(*) FILTER (verdict <> 'error') / count(*), 6) AS parse_rate"
    ),
)
_STATEMENTS = (
    "statements AS (SELECT row_id, fol FROM fol_corpus UNION ALL "
    "SELECT s_suppkey, concat('made_by(', replace(s_name, '#', '_'), ')') FROM supplier)"
)
_CONFLICTS = r"""apps AS (
    SELECT unnest(regexp_extract_all(fol, '[\p{L}\p{N}_]+\([^()]*\)')) AS app FROM statements),
  arity AS (
    SELECT split_part(app, '(', 1) AS pred, length(app) - length(replace(app, ',', '')) + 1 AS arity FROM apps)
  SELECT pred, string_agg(DISTINCT CAST(arity AS VARCHAR), ',' ORDER BY CAST(arity AS VARCHAR)) AS arities,
    count(*) AS uses FROM arity GROUP BY pred HAVING count(DISTINCT arity) > 1"""
add("arity_conflicts", f"WITH {_STATEMENTS}, {_CONFLICTS}", "fol_corpus")
# The same answer is due from the parsed nodes, as no statement nests applications.
add("arity_conflicts_from_nodes", f"WITH {_STATEMENTS}, {_CONFLICTS}", "fol_corpus")

def encoding_of(out: str, table: str, key: str, text: str) -> str:
    """CTE `out`(row_id, ids, text): ids of all tokens, and the known tokens, by the CTE vocab."""
    return f"""
  {out}_words AS (SELECT {key} AS row_id, unnest({tokens(text)}) AS token, generate_subscripts({tokens(text)}, 1) AS pos FROM {table}),
  {out}_coded AS (SELECT w.row_id, w.pos, w.token, coalesce(v.id, 1) AS id, v.id IS NOT NULL AS known
    FROM {out}_words w LEFT JOIN vocab v ON w.token = v.token),
  {out} AS (SELECT d.{key} AS row_id, list(c.id ORDER BY c.pos) FILTER (c.id IS NOT NULL) AS ids,
      string_agg(c.token, ' ' ORDER BY c.pos) FILTER (known) AS text
    FROM {table} d LEFT JOIN {out}_coded c ON d.{key} = c.row_id GROUP BY d.{key})"""


def vocab_of(table: str, text: str, size: int | None = None) -> str:
    limit = f"ORDER BY n DESC, token LIMIT {size}" if size else ""
    return f"""
  vocab AS (
    SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INT) AS id FROM (
      SELECT token, count(*) AS n FROM (SELECT unnest({tokens(text)}) AS token FROM {table}) words
      GROUP BY token {limit}) top)"""


VOCAB = vocab_of("documents", "text") + "," + encoding_of("encoded", "documents", "doc_id", "text")
add("vocab_build", f"WITH {vocab_of('documents', 'text', VOCAB_SIZE)} SELECT token, id FROM vocab")
_IDS = f"WITH {VOCAB} SELECT row_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM encoded"
add("encode", _IDS)
add("encode_by_join", _IDS)
_RUNS = "runs AS (SELECT concat(row_id, '/', run) AS row_id, fol_pred AS text FROM fol_predictions)"
add(
    "encode_repeated_ids",
    f"WITH {_RUNS}, {vocab_of('runs', 'text')}, {encoding_of('encoded', 'runs', 'row_id', 'text')} "
    "SELECT CAST(split_part(row_id, '/', 1) AS BIGINT) AS row_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM encoded",
    "fol_predictions",
)
add("decode", f"WITH {VOCAB} SELECT row_id, coalesce(text, '') AS text FROM encoded")
_ASKED = f"asked AS (SELECT row_id, concat({lit(t.TRANSLATE)}, nl) AS nl, {to_words('fol')} AS label FROM fol_corpus)"
_PADDED = f"array_to_string(list_resize(coalesce({{0}}, [])[1:{TRAINING_LENGTH}], {TRAINING_LENGTH}, 0), ' ')"
add(
    "training_rows",
    f"WITH {_ASKED}, {vocab_of('asked', 'nl')}, {encoding_of('source', 'asked', 'row_id', 'nl')}, "
    f"{encoding_of('target', 'asked', 'row_id', 'label')} SELECT s.row_id, {_PADDED.format('s.ids')} AS input_ids, "
    f"trim(concat(repeat('1 ', least(len(s.ids), {TRAINING_LENGTH})), "
    f"repeat('0 ', greatest({TRAINING_LENGTH} - len(s.ids), 0)))) AS attention_mask, "
    f"{_PADDED.format('t.ids')} AS labels FROM source s JOIN target t ON s.row_id = t.row_id",
    "fol_corpus",
)
_NEW = [f"[FOL_{b}]" for _, b in LITERALS] + ["the", "new_token"]
add(
    "extend_vocab",
    f"WITH {VOCAB}, new AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {lit(w)})" for i, w in enumerate(_NEW))
    + """) x(pos, token))
  SELECT token, id FROM vocab UNION ALL
  SELECT token, CAST((SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY pos) AS INT) FROM new
  WHERE token NOT IN (SELECT token FROM vocab)""",
)
add(
    "batch_pad",
    f"""WITH {VOCAB}, b AS (
    SELECT row_id, coalesce(ids, []) AS ids, (row_number() OVER (ORDER BY row_id) - 1) // {BATCH} AS batch_id FROM encoded),
  m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS missing FROM b)
  SELECT row_id, batch_id, trim(concat(repeat('0 ', missing), array_to_string(ids, ' '))) AS padded,
    trim(concat(repeat('0 ', missing), repeat('1 ', len(ids)))) AS mask FROM m""",
)
_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
add(
    "premise_context",
    f"""WITH n AS (SELECT example_id, idx, concat('𝜙', CAST(row_number() OVER (PARTITION BY example_id ORDER BY idx) AS VARCHAR),
      ' = ', fol) AS line FROM fol_premises WHERE kind = 'premise')
  SELECT example_id, idx, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY example_id ORDER BY idx {_EARLIER}), '') AS context
  FROM n""",
    "fol_premises",
)
add(
    "conclusion_context",
    f"""WITH n AS (SELECT example_id, idx, kind, concat('𝜙', CAST(row_number() OVER
      (PARTITION BY example_id, kind ORDER BY idx) AS VARCHAR), ' = ', fol) AS line FROM fol_premises)
  SELECT example_id, concat({lit(t.CHAIN_HEADER)}, coalesce(string_agg(line, chr(10) ORDER BY idx)
    FILTER (kind = 'premise'), '')) AS context FROM n GROUP BY example_id""",
    "fol_premises",
)
add(
    "running_chat_context",
    f"""WITH n AS (SELECT conv_id, turn, text, concat('𝜙', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR),
      ' = ', text) AS line FROM conversations),
  c AS (SELECT conv_id, turn, text, coalesce(concat({lit(t.CHAIN_HEADER)}, string_agg(line, chr(10)) OVER
      (PARTITION BY conv_id ORDER BY turn {_EARLIER})), '') AS raw,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM n),
  x AS (SELECT conv_id, turn, text, CASE WHEN rn = 1 THEN '' ELSE raw END AS context FROM c)
  """
    + messages("x", ("system", lit(t.CHAIN_SYSTEM)), ("assistant", "context"), ("user", "text"), keys="conv_id, turn"),
)
_BATCHES = f"""WITH b AS (SELECT row_id, nl, row_number() OVER (ORDER BY row_id) - 1 AS idx, count(*) OVER () AS n FROM fol_corpus)"""
add(
    "assign_batches",
    f"{_BATCHES} SELECT row_id, idx, idx // {BATCH} AS batch_id, idx // {BATCH} * {BATCH} AS batch_start, "
    f"least((idx // {BATCH} + 1) * {BATCH}, n) AS batch_end FROM b",
    "fol_corpus",
)
add(
    "batch_slice",
    f"{_BATCHES} SELECT row_id, idx, idx // {BATCH} AS batch_id FROM b WHERE idx // {BATCH} = 3",
    "fol_corpus",
)
add(
    "batch_rows",
    f"{_BATCHES} SELECT idx // {BATCH} AS batch_id, string_agg(row_id, ' ' ORDER BY idx) AS row_ids FROM b "
    f"GROUP BY idx // {BATCH}",
    "fol_corpus",
)

# -- scalar functions ------------------------------------------------------------------------------

add(
    "extract_predicates",
    f"SELECT row_id, run, array_to_string({preds('fol_pred')}, ',') AS preds FROM fol_predictions",
    "fol_predictions",
)
add(
    "sorted_names",
    f"SELECT row_id, array_to_string(list_sort(list_distinct({preds('fol')})), ',') AS preds FROM fol_corpus",
    "fol_corpus",
)
add(
    "identical",
    f"SELECT row_id, run, {bare('fol_pred')} = {bare('fol_gt')} AS same FROM fol_predictions",
    "fol_predictions",
)
add(
    "literals_to_words",
    f"SELECT row_id, {to_words('fol')} AS words, {to_brackets('fol')} AS brackets FROM fol_corpus",
    "fol_corpus",
)
_LONGEST_FIRST = sorted([(b, a) for a, b in LITERALS], key=lambda p: -len(p[0]))
add(
    "tokens_to_literals",
    f"SELECT row_id, fol AS from_brackets, {swap(to_words('fol'), _LONGEST_FIRST)} AS from_words FROM fol_corpus",
    "fol_corpus",
)
add(
    "after_last_equals",
    f"SELECT row_id, run, {last_equals('fol_pred')} AS formula FROM fol_predictions",
    "fol_predictions",
)
add(
    "predicted_list",
    f"SELECT row_id, {cut_list('preds_pred', 'last_line')} AS last_line, "
    f"{cut_list('preds_pred', 'last_marker')} AS last_marker FROM fol_stage1",
    "fol_stage1",
)
add(
    "format_predicates",
    "SELECT row_id, " + ", ".join(f"{formatted(OWN, f)} AS {f}" for f in ["plain", "quoted", "plain_nl", "bare"])
    + " FROM fol_corpus",
    "fol_corpus",
)
add(
    "clean_nl",
    f"SELECT row_id, regexp_replace(array_to_string({tokens('concat(nl, chr(32), chr(9), fol)')}, ' '), '_[^ ]*', '', 'g') "
    "AS nl FROM fol_corpus",
    "fol_corpus",
)
add(
    "norm_distance",
    "SELECT p_partkey AS row_id, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) AS d FROM "
    "(SELECT p_partkey, replace(p_name, ' ', '_') AS a, concat(lower(p_type), '_part') AS b FROM part) x",
)
add(
    "best_match",
    f"WITH RECURSIVE {RAW_MATCH} SELECT l.row_id, l.run, coalesce(string_agg(z, ',' ORDER BY i), '') AS best "
    "FROM lists l LEFT JOIN renames r ON l.row_id = r.row_id AND l.run = r.run GROUP BY l.row_id, l.run",
    "fol_predictions",
)
add("match_predicates", f"WITH RECURSIVE {RAW_MATCH} SELECT row_id, run, aligned FROM aligned", "fol_predictions")
_N = FIXED_LENGTH
add(
    "pad_truncate",
    f"WITH w AS (SELECT doc_id AS row_id, {tokens('text')} AS ws FROM documents), "
    "l AS (SELECT row_id, list_transform(ws, lambda x: length(x)) AS ids FROM w) "
    f"SELECT row_id, array_to_string(list_resize(ids[1:{_N}], {_N}, 0), ' ') AS input_ids, "
    f"trim(concat(repeat('1 ', least(len(ids), {_N})), repeat('0 ', greatest({_N} - len(ids), 0)))) AS mask FROM l",
)
add(
    "base_model",
    "SELECT doc_id AS row_id, CASE lang WHEN 'de' THEN '.' WHEN 'fr' THEN concat('/other/', source, '/fr') "
    "ELSE concat('hub/', source) END AS model FROM documents",
)
add(
    "safe_file_name",
    r"""SELECT page_id, regexp_replace(url, '[/\\:*?"<>|\x00-\x1f\x7f]', '', 'g') AS name FROM pages""",
)
add(
    "label",
    f"SELECT row_id, concat('𝜙=', fol) AS phi_fol, fol, {formatted(OWN, 'plain')} AS list FROM fol_corpus",
    "fol_corpus",
)
add(
    "next_stage",
    "SELECT p_partkey AS row_id, concat('curiculum_step', CAST(p_size + 1 AS VARCHAR)) AS stage FROM part",
)

# -- formulas --------------------------------------------------------------------------------------

_CONNECTIVES = ["n_forall", "n_exists", "n_and", "n_xor", "n_or", "n_implies", "n_iff", "n_not"]
add(
    "connective_profile",
    "SELECT row_id, "
    + ", ".join(f"len(string_split(fol, '{a}')) - 1 AS {n}" for n, (a, _) in zip(_CONNECTIVES, LITERALS))
    + " FROM fol_corpus",
    "fol_corpus",
)
# Nodes of the seven formula shapes, as read by hand:
# node_id, parent_id, pos, kind, symbol, depth, quantifier_depth, arity. A and B stand for the two names
# taken from the part, C for its brand. All variables are bound.
SHAPES = {
    0: "0 - 0 quantified ∀ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 implies → 1 1 -; 3 2 0 predicate A 2 1 1; "
    "4 3 0 variable x 3 1 -; 5 2 1 predicate B 2 1 1; 6 5 0 variable x 3 1 -",
    1: "0 - 0 quantified ∃ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 and ∧ 1 1 -; 3 2 0 predicate A 2 1 1; "
    "4 3 0 variable x 3 1 -; 5 2 1 predicate made_by 2 1 2; 6 5 0 variable x 3 1 -; 7 5 1 constant C 3 1 -",
    2: "0 - 0 quantified ∀ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 or ∨ 1 1 -; 3 2 0 not ¬ 2 1 -; "
    "4 3 0 predicate B 3 1 1; 5 4 0 variable x 4 1 -; 6 2 1 predicate A 2 1 1; 7 6 0 variable x 3 1 -",
    3: "0 - 0 quantified ∀ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 iff ↔ 1 1 -; 3 2 0 predicate A 2 1 1; "
    "4 3 0 variable x 3 1 -; 5 2 1 predicate B 2 1 1; 6 5 0 variable x 3 1 -",
    4: "0 - 0 quantified ∀ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 quantified ∀ 1 1 -; 3 2 0 variable y 2 2 -; "
    "4 2 1 implies → 2 2 -; 5 4 0 and ∧ 3 2 -; 6 5 0 predicate A 4 2 1; 7 6 0 variable x 5 2 -; "
    "8 5 1 predicate made_by 4 2 2; 9 8 0 variable x 5 2 -; 10 8 1 variable y 5 2 -; "
    "11 4 1 predicate brand 3 2 1; 12 11 0 variable y 4 2 -",
    5: "0 - 0 quantified ∃ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 xor ⊕ 1 1 -; 3 2 0 predicate A 2 1 1; "
    "4 3 0 variable x 3 1 -; 5 2 1 predicate B 2 1 1; 6 5 0 variable x 3 1 -",
    6: "0 - 0 quantified ∀ 0 0 -; 1 0 0 variable x 1 1 -; 2 0 1 implies → 1 1 -; 3 2 0 predicate A 2 1 1; "
    "4 3 0 variable x 3 1 -; 5 2 1 quantified ∃ 2 1 -; 6 5 0 variable y 3 2 -; 7 5 1 and ∧ 3 2 -; "
    "8 7 0 predicate made_by 4 2 2; 9 8 0 variable x 5 2 -; 10 8 1 variable y 5 2 -; 11 7 1 not ¬ 4 2 -; "
    "12 11 0 predicate B 5 2 1; 13 12 0 variable y 6 2 -",
}


def _shape_rows() -> str:
    rows = []
    for shape, text in SHAPES.items():
        for node in text.split("; "):
            i, parent, pos, kind, symbol, depth, quantifiers, arity = node.split(" ")
            rows.append(
                f"({shape}, {i}, {parent.replace('-', 'NULL')}, {pos}, '{kind}', '{symbol}', {depth}, {quantifiers}, "
                f"{arity.replace('-', 'NULL')})"
            )
    return ", ".join(rows)


NODES = f"""shape AS (SELECT * FROM (VALUES {_shape_rows()})
    s(shape, node_id, parent_id, pos, kind, symbol, depth, quantifier_depth, arity)),
  nodes AS (
    SELECT p_partkey AS row_id, node_id, parent_id, pos, kind,
      CASE symbol WHEN 'A' THEN replace(p_name, ' ', '_') WHEN 'B' THEN concat(lower(p_type), '_part')
        WHEN 'C' THEN replace(p_brand, '#', '') ELSE symbol END AS symbol,
      depth, quantifier_depth, arity, CASE WHEN kind = 'variable' THEN false END AS free
    FROM part JOIN shape ON p_partkey % 7 = shape)"""
add("parse_nodes", f"WITH {NODES} SELECT *, true AS parse_ok, {_NULL} AS reason FROM nodes")
_KINDS = ["and", "or", "xor", "implies", "iff", "not", "predicate", "constant"]
add(
    "formula_profile",
    f"WITH {NODES} SELECT row_id, true AS parse_ok, false AS ambiguous_scope, count(*) AS n_nodes, max(depth) AS depth, "
    "max(quantifier_depth + CASE WHEN kind = 'quantified' THEN 1 ELSE 0 END) AS quantifier_depth, "
    "count(*) FILTER (kind = 'quantified' AND symbol = '∀') AS n_forall, "
    "count(*) FILTER (kind = 'quantified' AND symbol = '∃') AS n_exists, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)
    + ", count(DISTINCT symbol) FILTER (kind = 'variable') AS n_variables, '' AS free_variables "
    "FROM nodes GROUP BY row_id",
)
add(
    "export_prover_text",
    f"""WITH v AS (SELECT p_partkey, replace(p_name, ' ', '_') AS a, concat(lower(p_type), '_part') AS b,
      replace(p_brand, '#', '') AS c FROM part),
  f AS (SELECT p_partkey // 4 AS example_id, p_partkey % 4 AS idx, CASE p_partkey % 7
      WHEN 0 THEN concat('all x ((', a, '(x) -> ', b, '(x)))')
      WHEN 1 THEN concat('exists x ((', a, '(x) & made_by(x, ', c, ')))')
      WHEN 2 THEN concat('all x ((-', b, '(x) | ', a, '(x)))')
      WHEN 3 THEN concat('all x ((', a, '(x) <-> ', b, '(x)))')
      WHEN 4 THEN concat('all x (all y (((', a, '(x) & made_by(x, y)) -> brand(y))))')
      WHEN 5 THEN concat('exists x (((', a, '(x) | ', b, '(x)) & -(', a, '(x) & ', b, '(x))))')
      ELSE concat('all x ((', a, '(x) -> exists y ((made_by(x, y) & -', b, '(y)))))') END AS line FROM v)
  SELECT example_id, concat({lit(t.PROVER_HEADER)},
    string_agg(concat('  ', line, '.', chr(10)), '' ORDER BY idx) FILTER (idx < 3), {lit(t.PROVER_GOALS)},
    max(concat('  ', line, '.', chr(10))) FILTER (idx = 3), {lit(t.PROVER_FOOTER)}) AS prover_input, {_NULL} AS reason
  FROM f GROUP BY example_id""",
)
add("verdicts", f"WITH RECURSIVE {CLEAN_MATCH} SELECT row_id, run, verdict FROM judged", "fol_predictions")

# -- generation and streaming ----------------------------------------------------------------------

_PROMPT = f"concat({lit(t.TRANSLATE)}, nl)"
add(
    "generate",
    f"SELECT row_id, {_PROMPT} AS prompt, concat('echo: ', {_PROMPT}) AS fol_pred FROM fol_corpus",
    "fol_corpus",
)
add(
    "training_data",
    messages(
        "fol_corpus", ("system", lit(t.SYSTEM)), ("user", "nl"), ("assistant", f"concat('𝜙=', {to_brackets('fol')})")
    ),
    "fol_corpus",
)
add(
    "predict",
    f"SELECT row_id, nl, concat('<|system|>', chr(10), {lit(t.SYSTEM)}, chr(10), '<|user|>', chr(10), nl, chr(10)) AS prompt, "
    "fol AS fol_gt, concat('𝜙=', nl, chr(10)) AS fol_pred FROM fol_corpus",
    "fol_corpus",
)
add(
    "predict_resumable",
    f"SELECT row_id, nl, {_PROMPT} AS prompt, fol AS fol_gt, concat('echo: ', {_PROMPT}) AS fol_pred FROM fol_corpus",
    "fol_corpus",
)
_NOISY_PROMPT = f"concat({lit(t.TRANSLATE_USING)}, {formatted(BOTH, 'quoted')}, nl)"
add(
    "predict_resumable_noisy",
    f"WITH {NOISE} SELECT row_id, nl, {_NOISY_PROMPT} AS prompt, fol AS fol_gt, concat('echo: ', {_NOISY_PROMPT}) AS fol_pred "
    "FROM with_noise",
    "fol_corpus",
)
_TWO_STEPS = f"concat({lit(t.TRANSLATE_USING)}, {cut_list('preds_pred', 'last_marker')}, nl)"
add(
    "predict_in_two_steps",
    f"WITH f AS (SELECT row_id, nl, fol, concat('echo: ', {lit(t.EXTRACT)}, nl) AS preds_pred FROM fol_corpus) "
    f"SELECT row_id, nl, {_TWO_STEPS} AS prompt, fol AS fol_gt, concat('echo: ', {_TWO_STEPS}) AS fol_pred, "
    f"{OWN} AS preds_gt FROM f",
    "fol_corpus",
)
add(
    "model_family",
    "SELECT doc_id AS row_id, CASE lang WHEN 'de' THEN 'seq2seq' WHEN 'fr' THEN 'seq2seq' WHEN 'es' THEN 'chat' END "
    "AS family FROM documents",
)
_FIRST = t.FEW_SHOT_REASONING_HEAD + t.ANSWER
_SECOND = t.FEW_SHOT_REASONING_HEAD + t.EARLIER_THOUGHTS + "thinking" + t.ANSWER
add(
    "call_with_retry",
    f"""WITH c AS (SELECT row_id, length(nl) % 4 AS fails, nl LIKE '%Brand 7.' AS silent FROM fol_corpus)
  SELECT row_id,
    CASE WHEN fails = 3 THEN 'fallback {len(_FIRST)}' WHEN silent THEN 'fallback {len(_SECOND)}' ELSE '𝜙={len(_FIRST)}' END AS fol_pred,
    CASE WHEN fails < 3 AND silent THEN 'thinking' ELSE '' END AS fol_pred_reasoning,
    CASE WHEN fails = 3 OR silent THEN 'fallback' ELSE 'ok' END AS status,
    CAST(CASE WHEN fails = 3 THEN 4 WHEN silent THEN fails + 2 ELSE fails + 1 END AS INT) AS attempts,
    fails = 3 OR silent AS fallback_used,
    CASE WHEN fails < 3 AND silent THEN 'empty answer' WHEN fails > 0 THEN 'ConnectionError: busy' END AS error
  FROM c""",
    "fol_corpus",
)
_USING_SHOTS = {names: f"concat({lit(t.FEW_SHOT_USING_HEAD)}, {formatted(names, 'quoted')}, {lit(t.ANSWER)})" for names in (OWN, BOTH)}
for _mode, _system in {
    "none": lit(t.FEW_SHOT),
    "own": _USING_SHOTS[OWN],
    "own_noise": _USING_SHOTS[BOTH],
    "reasoning": lit(_FIRST),
}.items():
    add(
        f"predict_remote_{_mode}",
        f"""WITH {NOISE}, c AS (SELECT row_id, nl, fol, length(nl) % 4 AS fails, nl LIKE '%Brand 7.' AS silent,
      length({_system}) AS asked FROM with_noise)
  SELECT row_id, nl, fol AS fol_gt,
    CASE WHEN fails = 3 THEN 'fallback {len(_FIRST)}' WHEN silent THEN 'fallback {len(_SECOND)}' ELSE concat('𝜙=', asked) END AS fol_pred,
    CASE WHEN fails < 3 AND silent THEN 'thinking' ELSE '' END AS reasoning, fails = 3 OR silent AS fallback_used,
    CASE WHEN fails = 3 OR silent THEN 'fallback' ELSE 'ok' END AS status FROM c""",
        "fol_corpus",
    )
add(
    "generate_sequential",
    f"WITH {EXAMPLES} SELECT example_id, premises AS premises_fol, conclusion AS conclusion_fol FROM ex",
    "fol_premises",
)
add(
    "stream_predictions",
    f"SELECT nl, {_PROMPT} AS prompt, concat('echo: ', {_PROMPT}) AS fol_pred, fol AS fol_gt FROM fol_corpus",
    "fol_corpus",
)
