"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same copy probability. Its whole part is taken for certain. Fractions
are rounded in pairs: words move at random from one document to the other until one of the two has no
fraction left. What one group leaves over meets what other groups leave over, level by level, so the words
of a source stay what they should be up to its last document. That one is rounded, and the words it adds or
lacks are made good by whole documents, chosen by counts per size over all documents of the source.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from formulary.llm.tables import numbered, stored
from formulary.operators.sampling import dense_index

WEIGHTS = (1, 2, 3)
MOST = 3  # copies of a document at most, as a mean over a source
GROUP_ROWS = 4000  # documents rounded in one group, about
FAN_IN = 64  # groups whose leftovers meet


def n_words(text: str | Column) -> Column:
    """Runs of other than the six ASCII white space characters; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rows, target: the words each source should give.

    Weights repeat over the sources in code point order, null last. All sizes are shared out by weight; a
    source stops at `most` times its size and the rest is shared again by weight among the others. Each round
    is one aggregation over the sources; only its three sums reach the driver.
    """
    ranked = dense_index(sources.withColumn("o", F.struct(F.col("source").isNull(), F.col("source"))), "o").drop("o")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        capped = cap <= F.col("weight") * F.lit(rate) if full >= 0 else F.lit(False)
        n, held, open_ = ranked.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not open_:
            break
        full, rate = n, (total - held) / open_
    target = F.when(capped, cap.cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def pair_off(sizes: list[int], parts: list[float], coins: list[float]) -> list[float]:
    """The fractions after pairing: all 0 or 1 but at most one. Words, size times fraction, stay the same in sum.

    Two fractions meet at a time. Words go one way or the other, as far as the receiving document is full
    or the giving one empty; the odds are such that each fraction keeps its mean.
    """
    out = list(parts)
    carry = -1
    for k, (size, part) in enumerate(zip(sizes, parts)):
        if size == 0 or part <= 0.0 or part >= 1.0:
            out[k] = 0.0 if size == 0 else part
            continue
        if carry < 0:
            carry = k
            continue
        a, b = carry, k
        up = min((1 - out[a]) * sizes[a], out[b] * sizes[b])  # words that can go from b to a
        down = min(out[a] * sizes[a], (1 - out[b]) * sizes[b])  # and from a to b
        if coins[k] * (up + down) < down:
            full, empty = (1 - out[a]) * sizes[a] <= up, out[b] * sizes[b] <= up
            out[a], out[b] = out[a] + up / sizes[a], out[b] - up / sizes[b]
            if full:
                out[a] = 1.0
            if empty:
                out[b] = 0.0
        else:
            empty, full = out[a] * sizes[a] <= down, (1 - out[b]) * sizes[b] <= down
            out[a], out[b] = out[a] - down / sizes[a], out[b] + down / sizes[b]
            if empty:
                out[a] = 0.0
            if full:
                out[b] = 1.0
        if 0.0 < out[a] < 1.0:
            carry = a
        elif 0.0 < out[b] < 1.0:
            carry = b
        else:
            carry = -1
    return out


def close(counts: dict[int, tuple[int, int]], missing: float) -> dict[int, int]:
    """size -> documents to turn over, so that `missing` words are made good by whole documents, large ones first.

    `counts` holds how many documents of a size were rounded down and up: one rounded down and turned over gives
    its words, one rounded up takes them. A document is turned over where that brings the sum closer.
    """
    out = {}
    for size in sorted(counts, reverse=True):
        turned = min(counts[size][missing < 0], max(0, math.ceil(abs(missing) / size - 0.5)))
        if turned:
            out[size] = -turned if missing < 0 else turned
            missing -= size * out[size]
    return out


PLACED = "source string, grp bigint, key bigint, dup bigint, size bigint, part double"


def coin(key: int, dup: int, level: int) -> float:
    """A number in [0, 1) that looks random and depends on its arguments alone."""
    mixed = (key * 0x9E3779B97F4A7C15 + dup * 0xBF58476D1CE4E5B9 + level * 0x94D049BB133111EB) % (1 << 64)
    mixed = (mixed ^ (mixed >> 29)) * 0xD1342543DE82EF95 % (1 << 64)
    return (mixed >> 11) / (1 << 53)


def _settle(last: bool, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "dup"], kind="stable").reset_index(drop=True)
        # Coins are a function of the documents, so a rerun repeats them.
        named = zip(rows["key"].tolist(), rows["dup"].tolist())
        coins = [coin(key, dup, level) for key, dup in named]
        parts = pair_off(rows["size"].tolist(), rows["part"].tolist(), coins)
        if last:
            parts = [float(math.floor(p + 0.5)) for p in parts]
        return rows.assign(part=parts)[["source", "grp", "key", "dup", "size", "part"]]

    return run


def rounded(items: DataFrame, levels: int) -> DataFrame:
    """source, key, dup, size and part (now 0 or 1) of items (source, grp, key, dup, size, part).

    Level by level every group (source, grp) is paired off and passes on at most one item with a fraction;
    `levels` times FAN_IN groups become one, after which each source has a single group, whose last fraction
    is rounded to the nearer side.
    """
    done, open_ = [], items
    for level in range(levels + 1):
        last = level == levels
        after = stored(open_.groupBy("source", "grp").applyInPandas(_settle(last, level), PLACED), f"mixed-{level}")
        settled = F.col("part").isin(0.0, 1.0)
        done.append(after.filter(settled).select("source", "key", "dup", "size", "part"))
        open_ = after.filter(~settled).withColumn("grp", F.expr(f"grp div {FAN_IN}"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def turned(parts: DataFrame, goals: DataFrame) -> DataFrame:
    """key, dup and turn (1 or -1) of the rounded documents to turn over, so that each source meets its target.

    All documents of a source count, by size; only the counts per size of a source meet in one task. Among
    documents of one size those of the least keys are turned over.
    """
    # Every document of a source had the same fraction.
    odds = F.col("target") / F.col("source_size")
    goals = goals.filter("source_size > 0").select(F.col("source").alias("_s"), (odds - F.floor(odds)).alias("want"))
    counts = parts.groupBy("source", "size").agg(F.count("*").alias("n"), F.sum("part").cast("bigint").alias("up"))
    counts = counts.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, n, up = (rows[c].tolist() for c in ("size", "n", "up"))
        missing = float(rows["want"].iloc[0]) * sum(s * a for s, a in zip(sizes, n)) - sum(s * b for s, b in zip(sizes, up))
        turns = close({s: (a - b, b) for s, a, b in zip(sizes, n, up)}, missing)
        name = rows["source"].iloc[0]
        out = [(None if pd.isna(name) else name, s, 0.0 if t > 0 else 1.0, abs(t)) for s, t in turns.items()]
        return pd.DataFrame(out, columns=["source", "size", "part", "turns"], dtype=object)

    chosen = counts.groupBy("source").applyInPandas(choose, "source string, size bigint, part double, turns bigint")
    chosen = stored(chosen.withColumn("kind", F.monotonically_increasing_id()), "turned")
    same = [parts["source"].eqNullSafe(chosen["source"]), parts["size"] == chosen["size"], parts["part"] == chosen["part"]]
    able = parts.join(chosen, same).select("kind", F.struct("key", "dup").alias("o"), parts["part"], "turns")
    first = dense_index(able, "o", by="kind").filter("idx < turns")
    return first.select("o.key", "o.dup", (1 - 2 * F.col("part")).cast("bigint").alias("turn"))


def doc_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")), "source")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, doc_id, size, source_size, target and copies of every row.

    size is the number of words; a null text has none. A document without words gets
    the whole copies of its source and moves no words. Rows without a source are one source, the last. Repeated
    rows count as documents of their own. A source's words differ from its target by at most half of
    one of its documents, and by less where shorter ones can make that good. Only doc_id, text and source are read; narrow rows are written when this is called.
    """
    source = F.col("source").cast("string")
    sizes = docs.select(F.col("doc_id").cast("bigint"), source, n_words("text").alias("size"), doc_key().alias("key"))
    # Rows with equal keys are told apart by a number of their own.
    sizes = stored(numbered(sizes, ["key"], "dup"), "sizes")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = stored(targets(sums, weights, most), "targets")
    largest = goals.agg(F.max("rows")).first()[0] or 0
    # One row per source: joined by broadcast only as far as Spark's own size limit allows.
    known = sizes.join(goals, sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    odds = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(odds).cast("bigint")
    known = known.select("*", whole.alias("whole"), (odds - whole).alias("part"))
    groups = F.ceil(F.col("rows") / GROUP_ROWS).cast("bigint")
    items = known.filter("size > 0 AND part > 0").select(
        "source", F.pmod(F.xxhash64("key", "dup"), groups).alias("grp"), "key", "dup", "size", "part"
    )
    groups_most = max(1, math.ceil(largest / GROUP_ROWS))
    levels = 0
    while FAN_IN**levels < groups_most:
        levels += 1
    parts = rounded(items, levels)
    turns = turned(parts, goals)
    out = known.join(parts.select("key", "dup", F.col("part").alias("more")), ["key", "dup"], "left")
    out = out.join(turns, ["key", "dup"], "left")
    more = F.coalesce("more", F.lit(0.0)).cast("bigint") + F.coalesce("turn", F.lit(0))
    copies = (F.col("whole") + more).alias("copies")
    return out.select("key", "doc_id", "size", "source_size", "target", copies)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) and copies of every row; see copies."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return copies(docs, weights, most).select("doc_id", "size", "source_size", "target", taken, "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of `docs`, unchanged, each as often as the mix takes it.

    Rows that agree in doc_id, text and source stand for each other: one of them carries all their copies.
    """
    often = copies(docs, weights, most).groupBy("key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    # The caller's row travels as one column, so none of its names can meet a name used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rank = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("rank")
    # A row leaves each task once, so one that is repeated very often fills no task.
    one = docs.select(doc_key().alias("key"), row, rank).groupBy("key").agg(F.min_by("row", "rank").alias("row"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))
    return one.join(often, "key").select("row", each).select("row.*")
