"""Benchmark passages in documents by winnowing, in DataFrame functions only.

A window is a run of `size` words. Its anchor is the least hash of the `seed`-word grams in it, so equal
windows have equal anchors wherever they stand: a span of `size` words that a document shares with an item is
always met through its anchor. Documents are joined with the items on anchors first; only hits are extended
to both sides, over the windows that hold the anchor, and compared with whole windows of the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from formulary.llm.tables import stored

SIZE = 10  # words of a window
SEED = 4  # words of an anchor
BLOCK = 4096  # windows of a document laid out at once
MAX_BROADCAST = 500_000  # rows of a side that may be sent to every task; more are joined by a shuffle
MAX_BROADCAST_BYTES = 32 << 20  # of texts, besides

BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes letters beyond A-Z, but of an ASCII text no others; it is several times faster.
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def doc_key() -> list[Column]:
    """Columns that tell rows apart up to wholly equal ones, whose results are equal: no null among them."""
    return [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id0"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("tkey"),
    ]


def anchor(hashes: list[Column], seed: int) -> Column:
    """The least gram hash of a window given the hashes of its words."""
    seed = min(seed, len(hashes))
    grams = [F.xxhash64(*hashes[i : i + seed]) for i in range(len(hashes) - seed + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def windows(rows: DataFrame, keys: list[str], size: int, seed: int) -> DataFrame:
    """keys, start, g (the anchor), w1 and w2 (128 bits of the window) of every run of `size` words.

    `rows` has the keys and `words`. A text is laid out in blocks of BLOCK windows, so a very long one does
    not become one very wide row.
    """
    # No filter on the words: Spark would move it below their projection and split every text once more.
    cuts = f"""CASE WHEN size(words) < {size} THEN array() ELSE transform(
        sequence(0, (size(words) - {size}) div {BLOCK}),
        b -> struct(b, slice(words, CAST(b AS INT) * {BLOCK} + 1, {BLOCK + size - 1}) AS w)) END"""
    held = rows.select(*keys, F.explode(F.expr(cuts)).alias("cut"))
    hashed = held.select(*keys, F.col("cut.b").alias("b"), F.transform("cut.w", lambda w: F.xxhash64(w)).alias("h"))
    shifted = [F.slice("h", k + 1, F.size("h") - (size - 1)).alias(f"h{k}") for k in range(size)]
    laid = hashed.select(*keys, "b", F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))
    each = [F.col(f"z.h{k}") for k in range(size)]
    return laid.select(
        *keys,
        (F.col("b").cast("bigint") * BLOCK + F.col("at")).alias("start"),
        anchor(each, seed).alias("g"),
        F.xxhash64(*each).alias("w1"),
        F.xxhash64(F.lit(size), *each[::-1]).alias("w2"),
    )


def item_windows(items: DataFrame, size: int, seed: int) -> tuple[DataFrame, list[int]]:
    """(written table: size, g, w1, w2, item of every window of every item, each once; sizes that occur).

    An item of fewer than `size` words is one window of its own size. `item` is the id as text, '' where null.
    """
    named = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")
    )
    n = F.least(F.size("words"), F.lit(size))
    sizes = sorted(k for (k,) in named.select(n).distinct().collect() if k > 0)  # at most `size` values
    parts = []
    for k in sizes:
        own = named if k == size else named.filter(F.size("words") == k)
        parts.append(windows(own, ["item"], k, seed).select(F.lit(k).alias("size"), "g", "w1", "w2", "item"))
    if not parts:
        return named.limit(0), []
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return stored(whole.distinct(), "benchmark-windows"), sizes


def small(df: DataFrame, limit: int) -> DataFrame:
    """`df` marked for a broadcast if its counted rows and the counted bytes of its texts allow it."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))
    rows, held = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= limit and held <= MAX_BROADCAST_BYTES else df


def hit_windows(
    docs: DataFrame, held: DataFrame, sizes: list[int], seed: int, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """id0, tkey, start, size, w1, w2 of the documents' windows that are windows of items, equal rows once.

    Anchors of the benchmark go to every task if their counted number allows it. A larger benchmark is met by
    shuffles of winnowed anchors, runs of equal ones once, after which only documents with a hit are laid out again.
    """
    keys = ["id0", "tkey"]
    rows = docs.select(*doc_key(), words_of(F.col("text")).alias("words"))
    known = held.select("size", "w1", "w2").distinct()
    out = None
    for size in sizes:
        of_size = known.filter(F.col("size") == size).drop("size")
        anchors = held.filter(F.col("size") == size).select("g").distinct()
        mine = windows(rows, keys, size, seed)
        if anchors.limit(max_broadcast + 1).count() <= max_broadcast:
            seeds = mine.join(F.broadcast(anchors), "g", "left_semi")
        else:
            picked = mine.select(*keys, "g").distinct()
            hits = stored(picked.join(anchors, "g", "left_semi"), "anchor-hits", heavy=True)
            again = docs.select("*", *doc_key()).join(hits.select(*keys).distinct(), keys, "left_semi")
            again = again.select(*keys, words_of(F.col("text")).alias("words"))
            seeds = windows(again, keys, size, seed).join(hits, [*keys, "g"], "left_semi")
        extended = seeds.join(small(of_size, max_broadcast), ["w1", "w2"], "left_semi")
        found = extended.select(*keys, "start", F.lit(size).alias("size"), "w1", "w2").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def covered(hits: DataFrame) -> DataFrame:
    """id0, tkey, n_hit: words of a document that lie in at least one of its hit windows."""
    spans = hits.select("id0", "tkey", "start", (F.col("start") + F.col("size")).alias("stop"))
    spans = spans.groupBy("id0", "tkey", "start").agg(F.max("stop").alias("stop"))
    earlier = Window.partitionBy("id0", "tkey").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(earlier), F.lit(0))))
    return spans.select("id0", "tkey", fresh.alias("fresh")).groupBy("id0", "tkey").agg(F.sum("fresh").alias("n_hit"))


def leaked(
    docs: DataFrame, items: DataFrame, size: int = SIZE, seed: int = SEED, max_broadcast: int = MAX_BROADCAST
) -> tuple[DataFrame, DataFrame]:
    """(hit spans: id0, tkey, start, size; items met: id0, tkey, item, each once), of documents by `doc_key`.

    Both come from one written table of hit windows.
    """
    held, sizes = item_windows(items, size, seed)
    if not sizes:
        none = docs.select(*doc_key()).limit(0)
        at = none.select("*", F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("size"))
        return at, none.withColumn("item", F.lit(""))
    hits = stored(hit_windows(docs, held, sizes, seed, max_broadcast), "hit-windows")
    named = small(held.select("size", "w1", "w2", "item"), max_broadcast)
    met = hits.join(named, ["size", "w1", "w2"]).select("id0", "tkey", "item").distinct()
    return hits.select("id0", "tkey", "start", "size"), met


def decontaminated(
    docs: DataFrame, items: DataFrame, size: int = SIZE, seed: int = SEED, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of `docs`.

    Words are runs of letters and digits, A-Z in lower case; characters beyond ASCII count as letters. A word
    is hit where it lies in a run of `size` words that also stands in an item; an item of fewer words, but
    not none, counts as a whole. n_items are the items with such a run, items_sha256 is over their ids, as
    text, sorted and joined by commas. A null or empty text has no words, and such an item no window. Items of
    one id count as one item with the windows of all; those without an id as one whose id is the empty text.
    Repeated rows, rows without doc_id and rows that share one keep results of their own text. Only doc_id and text,
    item_id and text are read. Windows are compared by 128 bits made of 64 bits a word. The items' windows and the
    hits are written when this is called.
    """
    if not 0 < seed <= size:
        raise ValueError("seed must be at least 1 word and no longer than size")
    spans, met = leaked(docs, items, size, seed, max_broadcast)
    listed = F.sort_array(F.collect_set("item"))
    lists = met.groupBy("id0", "tkey").agg(
        F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256")
    )
    # Written down, so that Spark can split the rows of one document that is repeated very often.
    found = stored(covered(spans).join(lists, ["id0", "tkey"]), "contaminated")
    n_words = F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")
    rows = docs.select(F.col("doc_id").cast("bigint"), *doc_key(), n_words)
    return rows.join(found, ["id0", "tkey"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
