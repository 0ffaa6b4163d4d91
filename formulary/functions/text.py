"""Column functions on sentences, formulas and model output. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The eight literals of the logic, their word and bracket spellings, the answer marker,
# and the characters that count as whitespace.
LITERALS = ["∀", "∃", "∧", "⊕", "∨", "→", "↔", "¬"]
WORDS = ["FORALL", "EXISTS", "AND", "XOR", "OR", "IMPLIES", "IFF", "NOT"]
BRACKETS = [f"[FOL_{word}]" for word in WORDS]
PHI = "𝜙"
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
UNICODE = "(?U)"  # makes \s mean every Unicode space

_FORBIDDEN_IN_FILE_NAMES = r'[/\\:*?"<>|\x00-\x1f\x7f]'


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_space(c) -> Column:
    return F.regexp_replace(_col(c), f"{UNICODE}{SPACE}+", "")


def strip(c) -> Column:
    return F.regexp_replace(_col(c), f"{UNICODE}^{SPACE}+|{SPACE}+$", "")


def words(c) -> Column:
    """Whitespace-separated tokens; an empty array for blank text."""
    return F.regexp_extract_all(_col(c), F.lit(f"{UNICODE}{NON_SPACE}+"), F.lit(0))


def identical(a, b) -> Column:
    """Equal once all whitespace is gone."""
    return remove_space(a) == remove_space(b)


def _replace_each(c: Column, old: list[str], new: list[str]) -> Column:
    for o, n in zip(old, new):
        c = F.replace(c, F.lit(o), F.lit(n))
    return c


def literals_to_words(c) -> Column:
    return _replace_each(_col(c), LITERALS, WORDS)


def literals_to_bracket_tokens(c) -> Column:
    return _replace_each(_col(c), LITERALS, BRACKETS)


def tokens_to_literals(c, form: str = "brackets") -> Column:
    """Back to literals. The word form is lossy inside names, so it has to be asked for."""
    if form == "brackets":
        return _replace_each(_col(c), BRACKETS, LITERALS)
    if form != "words":
        raise ValueError(f"unknown token form {form!r}")
    pairs = sorted(zip(WORDS, LITERALS), key=lambda p: -len(p[0]))
    return _replace_each(_col(c), [w for w, _ in pairs], [x for _, x in pairs])


def map_literals(c, spelling: Column) -> Column:
    """Spelling chosen per row: words, brackets, or anything else for no change."""
    c = _col(c)
    return (
        F.when(spelling == "words", literals_to_words(c))
        .when(spelling == "brackets", literals_to_bracket_tokens(c))
        .otherwise(c)
    )


def after_last_equals(c) -> Column:
    """Text behind the last '='; the whole text when there is none."""
    return strip(F.substring_index(_col(c), "=", -1))


def predicted_list(c, rule) -> Column:
    """Cut the predicate list out of a first-step answer.

    last_line takes the last line. last_marker takes everything from the last 'Predicates'; without that
    word only the last character remains.
    """
    c = _col(c)
    rule = F.lit(rule) if isinstance(rule, str) else rule
    marked = F.when(
        F.contains(c, F.lit("Predicates")),
        F.concat(F.lit("Predicates"), F.substring_index(c, "Predicates", -1)),
    ).otherwise(F.right(c, F.lit(1)))
    return strip(F.when(rule == "last_line", F.substring_index(c, "\n", -1)).otherwise(marked))


def clean_nl(c, prefix) -> Column:
    """Drop the prompt prefix, cut each token at its first underscore, rejoin with one blank."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    bare = F.when(prefix == "", _col(c)).otherwise(F.replace(_col(c), prefix, F.lit("")))
    return F.array_join(F.transform(words(bare), lambda t: F.substring_index(t, "_", 1)), " ")


def pad_truncate(ids, length: int, pad: int = 0) -> Column:
    """Exactly `length` ids: the tail is cut or filled with `pad`."""
    ids = _col(ids)
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), missing)), 1, length)


def attention_mask(ids, length: int) -> Column:
    real = F.least(F.size(_col(ids)), F.lit(length))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= real).cast("int"))


def _normal_path(path: Column) -> Column:
    one_slash = F.regexp_replace(path, "/+", "/")
    no_dots = F.regexp_replace(F.regexp_replace(one_slash, r"(/\.)+(?=/|$)", ""), r"^\./", "")
    no_tail = F.regexp_replace(no_dots, "(?<=.)/$", "")
    rooted = F.when((no_tail == "") & F.startswith(path, F.lit("/")), F.lit("/")).otherwise(no_tail)
    return F.when(rooted == "", F.lit(".")).otherwise(rooted)


def base_model(path, home: str) -> Column:
    """Parent folder, relative to `home`, of a path below `home`; any other path is kept."""
    home = home.rstrip("/")
    normal = _normal_path(_col(path))
    below = F.substring(normal, len(home) + 2, 2**31 - 1)
    return (
        F.when(normal == home, F.lit("."))
        .when(
            F.startswith(normal, F.lit(home + "/")),
            F.when(F.contains(below, F.lit("/")), F.regexp_replace(below, "/[^/]*$", "")).otherwise("."),
        )
        .otherwise(normal)
    )


def safe_file_name(c) -> Column:
    return F.regexp_replace(_col(c), _FORBIDDEN_IN_FILE_NAMES, "")


def label(fol, kind, preds=None) -> Column:
    """Training target: 'phi_fol', 'fol' or 'list' (a ready-made predicate list)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    listed = F.lit(None).cast("string") if preds is None else _col(preds)
    return (
        F.when(kind == "phi_fol", F.concat(F.lit(PHI + "="), _col(fol)))
        .when(kind == "fol", _col(fol))
        .when(kind == "list", listed)
    )


def next_stage(c) -> Column:
    """Name of the following curriculum stage: the trailing number grows by one."""
    c = _col(c)
    number = F.regexp_extract(c, r"(\d+)$", 1)
    return F.when(
        number != "",
        F.concat(F.regexp_replace(c, r"\d+$", ""), (F.try_to_number(number, F.lit("9" * 18)) + 1).cast("bigint")),
    )


def connective_counts(fol) -> dict[str, Column]:
    """Occurrences of each literal in the formula text."""
    fol = _col(fol)
    names = ["n_forall", "n_exists", "n_and", "n_xor", "n_or", "n_implies", "n_iff", "n_not"]
    return {
        name: (F.length(fol) - F.length(F.replace(fol, F.lit(ch), F.lit("")))).cast("bigint")
        for name, ch in zip(names, LITERALS)
    }
