"""Dense row positions, batches, and reproducible noise rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from formulary.functions import predicates as P
from formulary.operators import prompts
from formulary.session import cut, store

DRAWS = 10  # least number of hashed positions tried per row, two per md5
MAX_BROADCAST_OFFSETS = 200_000


def _renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` under names that meet no helper's, and the name that each of its columns has got."""
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def _named(names: dict[str, str], *but: str) -> list[Column]:
    """The columns of a `_renamed` table under their own names; those in `but` are replaced by others."""
    return [F.col(inner).alias(name) for name, inner in names.items() if name not in but]


def dense_index(df: DataFrame, order: str = "row_id", by: str | None = None) -> DataFrame:
    """Adds `idx`, the 0-based position in `order` (within `by` if given), and `n`, the number of positions.

    Two passes instead of one global window: the rows are sorted in range partitions and written down with
    their place in the partition, which then never changes; counts per partition give each partition its
    first position. Rows of one `order` value, null too, are parted by where they came from, so a value that
    very many rows share is sorted by many tasks. The rows are sorted and written whole, so hand in keys, not
    wide rows: see with_index. Columns named idx or n are replaced. Jobs run when this is called.
    """
    rows, names = _renamed(df)
    keyed = rows.withColumns({"g": F.col(names[by]) if by else F.lit(0), "tie": F.monotonically_increasing_id()})
    place = {
        "pid": F.spark_partition_id(),
        "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    }
    placed = store(keyed.orderBy("g", names[order], "tie").drop("tie").withColumns(place), "indexed")
    sizes = placed.groupBy("pid", "g").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    earlier = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        sizes.select(
            F.col("pid").alias("of_pid"),
            F.col("g").alias("of_g"),
            (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("c").over(Window.partitionBy("g")).alias("all"),
        )
    )
    # One row per partition and group it touches: normally as many as there are partitions.
    if offsets.count() <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    out = placed.join(offsets, (F.col("pid") == F.col("of_pid")) & F.col("g").eqNullSafe(F.col("of_g")))
    return out.select(
        *_named(names, "idx", "n"), (F.col("pos") + F.col("shift")).alias("idx"), F.col("all").alias("n")
    )


def with_index(df: DataFrame, keys: DataFrame, order: str = "row_id", by: str | None = None) -> DataFrame:
    """`df` with `idx` and `n` as dense_index gives them, numbering only the `order` (and `by`) columns of `keys`.

    `keys` holds the same values as `df`, cheap to read: wide rows are then neither sorted nor copied, and
    nothing that computes them runs twice. They are joined to their numbers by `order`, null being a value like
    any other. Rows that share a value share out its numbers: only where some do, `df` is written down with
    the place of each row, and counts per partition and value give each partition its first number. Columns of
    `df` named idx or n are replaced.
    """
    on = [order, by] if by else [order]
    positions = dense_index(keys.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)]), "k0", "k1" if by else None)
    firsts = positions.groupBy(*[f"k{i}" for i in range(len(on))]).agg(
        F.min("idx").alias("first"), F.first("n").alias("all"), F.count("*").alias("c")
    )
    firsts = store(firsts, "numbers")
    rows, names = _renamed(df)
    own = [names[c] for c in on]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, [F.col(c).eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(own)])

    def numbered(rows: DataFrame, idx: Column) -> DataFrame:
        return rows.select(*_named(names, "idx", "n"), idx.alias("idx"), F.col("all").alias("n"))

    if firsts.filter("c > 1").isEmpty():
        return numbered(joined(rows, firsts), F.col("first"))
    place = {"pid": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}
    placed = store(rows.withColumns(place), "shared")
    earlier = Window.partitionBy(*own).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("pid", *own).agg(F.count("*").alias("rows"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    starts = joined(sizes, firsts).select(
        F.col("pid").alias("of_pid"),
        *[f"k{i}" for i in range(len(on))],
        (F.col("first") + F.col("before")).alias("start"),
        "all",
    )
    within = Window.partitionBy("pid", *own).orderBy("pos")
    ranked = placed.withColumn("k", F.row_number().over(within) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(own)]
    return numbered(ranked.join(starts, [F.col("pid") == F.col("of_pid"), *same]), F.col("start") + F.col("k"))


def assign_batches(
    df: DataFrame, batch_size: int, order: str = "row_id", keys: DataFrame | None = None
) -> DataFrame:
    """Consecutive batches of `batch_size` rows, the last one possibly short: [batch_start, batch_end).

    `keys` holds the `order` values of `df` where `df` itself is expensive to compute (see with_index). Columns of
    `df` with the names that are added are replaced, all others stay.
    """
    made = ("idx", "batch_id", "batch_start", "batch_end")
    rows, names = _renamed(df)
    keys = (df if keys is None else keys).select(F.col(f"`{order}`").alias(names[order]))
    batch, size = F.expr(f"idx div {batch_size}"), F.lit(batch_size)
    return with_index(rows, keys, names[order]).select(
        *_named(names, *made),
        "idx",
        batch.alias("batch_id"),
        (batch * size).alias("batch_start"),
        F.least((batch + 1) * size, F.col("n")).alias("batch_end"),
    )


def batch_slice(batches: DataFrame, batch_id: int) -> DataFrame:
    """The rows of one batch."""
    return batches.filter(F.col("batch_id") == batch_id)


def batch_rows(batches: DataFrame) -> DataFrame:
    """(batch_id, row_ids): every batch as one row, its ids in order; a batch bounds the list."""
    placed = F.sort_array(F.collect_list(F.struct("idx", "row_id")))
    return batches.groupBy("batch_id").agg(placed["row_id"].alias("row_ids"))


def _hash60(digest: Column, half: int) -> Column:
    """60 bits of an md5 digest, wide enough for any row count: half 0 or 1."""
    return F.conv(F.substring(digest, 1 + 16 * half, 15), 16, 10).cast("bigint")


def drawn_positions(row_id: Column, n: Column, k: int, seed: int) -> Column:
    """min(k, n) distinct positions below n, a function of row, seed and n only.

    Hashed draws with repeats removed; should too few differ, the positions after the first draw follow, of
    which min(k, n) always differ.
    """
    key = F.concat(row_id.cast("string"), F.lit(f":{seed}:"))
    # Written out one by one, as these stay in generated code, which a function over an array does not.
    digests = [F.md5(F.concat(key, F.lit(str(i)))) for i in range(max(DRAWS, 2 * k) // 2)]
    draws = [_hash60(d, half) % n for d in digests for half in (0, 1)]
    following = [(draws[0] + i) % n for i in range(1, k + 1)]
    return F.slice(F.array_distinct(F.array(*draws, *following)), 1, k)


def _numbered(corpus: DataFrame) -> DataFrame:
    """_row (the corpus's own number of a row), row_id, split, preds, idx and n: positions within the split."""
    rows = corpus.select("_row", "row_id", "split", P.extract_predicates("fol").alias("preds"))
    return dense_index(rows, by="split")


def _drawn(numbered: DataFrame, k: int, seed: int) -> DataFrame:
    """_row, row_id, peer_id, preds: min(k, n) random rows of the split for each row.

    An equi-join on (split, idx); positions are uniform, so no join key is hot and the output is k rows
    per input row.
    """
    positions = F.explode(drawn_positions(F.coalesce(F.col("row_id").cast("string"), F.lit("")), F.col("n"), k, seed))
    asked = numbered.select("_row", "row_id", F.col("split").alias("of_split"), positions.alias("of_idx"))
    peers = numbered.select("split", "idx", F.col("row_id").alias("peer_id"), "preds")
    same = F.col("of_split").eqNullSafe(F.col("split")) & (F.col("of_idx") == F.col("idx"))
    return asked.join(peers, same).select("_row", "row_id", "peer_id", "preds")


def noise_rows(corpus: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(row_id, peer_id, preds): min(k, n) distinct random rows of the same split, the row itself possible.

    Rows are drawn for every row, also where ids repeat or are null; rows of one id draw the same positions.
    Row number, id, split and predicates are sorted and written when this is called.
    """
    rows = corpus.select("row_id", "split", "fol").withColumn("_row", F.monotonically_increasing_id())
    return _drawn(_numbered(rows), k, seed).drop("_row")


def noise_predicate_set(noise: DataFrame, by: str = "row_id") -> DataFrame:
    """(row_id, noise): sorted union of the names over the k sampled rows."""
    return noise.groupBy(by).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("preds")))).alias("noise"))


def with_noise(corpus: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """The corpus with sampled predicate names in `noise`, which replaces a column of that name.

    The corpus is written once with a number of its own for each row, by which the draws come back: rows that
    share a row_id, or have none, keep their prompts.
    """
    rows, names = _renamed(corpus)
    kept = store(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered-corpus")
    keys = kept.select("_row", *[F.col(names[c]).alias(c) for c in ("row_id", "split", "fol")])
    noise = noise_predicate_set(_drawn(_numbered(keys), k, seed), "_row")
    return kept.join(noise, "_row").select(*_named(names, "noise"), "noise")


def prompt_noisy_preds(
    corpus: DataFrame, family: str = "seq2seq", k: int = 5, seed: int = 0, version: str = "raw"
) -> DataFrame:
    """Prompts whose predicate list is the row's own names and those of k random rows."""
    return prompts.prompt_with_noise(with_noise(corpus, k, seed), family, version)
