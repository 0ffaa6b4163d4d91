"""Predicate names inside formulas: extraction, formatting, distance, alignment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from formulary.functions.text import _col

# Fixed value: a predicate name is a run of letters, digits and underscores right before '('.
PREDICATE = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]++(?=\()"
# Fixed value: largest accepted distance, inclusive.
MAX_NORM_DISTANCE = 0.6


def extract_predicates(fol) -> Column:
    """All names in order of occurrence, repeats kept."""
    return F.regexp_extract_all(_col(fol), F.lit(PREDICATE), F.lit(0))


def sorted_names(*arrays) -> Column:
    """Set union of name lists in code-point order."""
    union = _col(arrays[0])
    for other in arrays[1:]:
        union = F.array_union(union, _col(other))
    return F.sort_array(F.array_distinct(union))


def bare_list(arr) -> Column:
    return F.array_join(_col(arr), ", ")


def format_predicates(arr, fmt) -> Column:
    """plain `Predicates=[A, B]`, quoted `Predicates=["A, B"]` + newline, plain_nl, or bare `A, B`."""
    return format_bare(bare_list(arr), fmt)


def format_bare(bare: Column, fmt) -> Column:
    """The formats of `format_predicates` for names already joined."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    plain = F.concat(F.lit("Predicates=["), bare, F.lit("]"))
    return (
        F.when(fmt == "plain", plain)
        .when(fmt == "quoted", F.concat(F.lit('Predicates=["'), bare, F.lit('"]\n')))
        .when(fmt == "plain_nl", F.concat(plain, F.lit("\n")))
        .when(fmt == "bare", bare)
    )


def norm_distance(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def nearest(name: Column, names: Column) -> Column:
    """struct(d, k, name) of the closest entry; the smallest position k wins a tie."""
    return F.array_min(
        F.transform(names, lambda b, k: F.struct(norm_distance(name, b).alias("d"), k.alias("k"), b.alias("name")))
    )


def best_match(name, names) -> Column:
    """The closest of `names` if near enough, else the name itself."""
    name, names = _col(name), _col(names)
    near = nearest(name, names)
    # An exact hit has distance 0, so the quadratic distance is only paid for unknown names.
    return F.when(F.array_contains(names, name), name).otherwise(
        F.when(near["d"] <= MAX_NORM_DISTANCE, near["name"]).otherwise(name)
    )


def rename_in_order(formula, renames) -> Column:
    """Apply array<struct<old,new>> one after the other to `old(`; later renames see earlier results."""
    return F.aggregate(
        _col(renames),
        _col(formula),
        lambda acc, r: F.replace(acc, F.concat(r["old"], F.lit("(")), F.concat(r["new"], F.lit("("))),
    )


def renames(names, gt_names) -> Column:
    """One old/new pair per predicted name that changes, in order of occurrence."""
    gt = F.array_distinct(_col(gt_names))
    pairs = F.transform(_col(names), lambda a: F.struct(a.alias("old"), best_match(a, gt).alias("new")))
    return F.filter(pairs, lambda r: r["old"] != r["new"])
