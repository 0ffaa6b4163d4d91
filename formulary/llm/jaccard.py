"""Near-duplicate texts: all pairs whose five-word shingles have a Jaccard similarity of at least 0.8.

MinHash LSH in bands: each text has a MinHash label in every tree, and texts with equal labels are candidates.
Labels have one length, the longest at which the expected share of pairs at the threshold that meet in some
tree reaches the target, so a pair can be missed, with at most the rest of that probability. Candidates are compared exactly, in blocks of a trie
node's texts. Equal shingle sets count as one text with copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from formulary.llm.graphs import components
from formulary.llm.substrings import Hasher, Runs, keyed_texts, mixed, text_tag
from formulary.llm.tables import stored

WORDS = 5  # of a shingle
THRESHOLD = 0.8
TREES, DEEPEST = 36, 8
RECALL = 0.999999  # at the threshold; more similar pairs meet more often
BLOCK_TEXTS = 256  # texts of a node compared at once with as many others
BLOCK_SHINGLES = 1_000_000  # and shingles of such a block, about


def prefix_length(threshold: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with probability `recall`."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("too few trees for this recall")


def shingle_sets(texts: Iterable[str | None], hasher: Hasher, size: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its shingles as sorted different hashes) of every text with a word.

    A text of fewer than `size` words is one shingle.
    """
    for rows, counts, words in hasher.portions(texts):
        if not len(words):
            continue
        runs = Runs(words, hasher.words[0])
        ends = np.cumsum(counts)
        starts = np.arange(max(0, len(words) - size + 1))
        grams = runs(starts, starts + size)
        for row, n, end in zip(rows.tolist(), counts.tolist(), ends.tolist()):
            if n >= size:
                yield row, np.unique(grams[end - n : end - size + 1])
            elif n:
                yield row, runs(np.array([end - n]), np.array([end])) ^ np.uint64(n)


class Forest:
    """MinHash labels cut to a prefix, as one node number per tree."""

    def __init__(self, trees: int, depth: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        numbers = rng.integers(0, 1 << 64, size=(2, trees * depth), dtype=np.uint64)
        self.flip, self.step = numbers[0], numbers[1] | np.uint64(1)

    def nodes(self, sets: list[np.ndarray]) -> np.ndarray:
        values = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), self.trees), np.uint64)
        with np.errstate(over="ignore"):
            for t in range(self.trees):
                node = np.full(len(sets), t + 1, np.uint64)
                for k in range(t * self.depth, (t + 1) * self.depth):
                    least = np.minimum.reduceat((values ^ self.flip[k]) * self.step[k], starts)
                    node = mixed(node * np.uint64(0x9E3779B97F4A7C15) + least)
                out[:, t] = node
        return out.view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        sums = mixed(shingles).sum(), mixed(shingles * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum()
    return np.array(sums, ">u8").tobytes()


LABELS = "doc_id bigint, tag bigint, item binary, shingles bigint, nodes array<bigint>"


def labels(texts: DataFrame, trees: int, depth: int, size: int) -> DataFrame:
    """doc_id, tag, item (key of the shingle set), shingles and nodes of every text that has a word."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, forest = Hasher(), Forest(trees, depth)
        for batch in batches:
            rows, sets, held = [], [], 0

            def made() -> pa.RecordBatch:
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * trees)
                nodes = pa.ListArray.from_arrays(offsets, pa.array(forest.nodes(sets).ravel()))
                ids, tags = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "tag"))
                keys = pa.array([_set_key(s) for s in sets], pa.binary())
                counts = pa.array([len(s) for s in sets], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [ids, tags, keys, counts, nodes], ["doc_id", "tag", "item", "shingles", "nodes"]
                )

            for row, shingles in shingle_sets((t.as_py() for t in batch.column("text")), hasher, size):
                rows.append(row)
                sets.append(shingles)
                held += len(shingles)
                if held > 1 << 17:
                    yield made()
                    rows, sets, held = [], [], 0
            if rows:
                yield made()

    return texts.mapInArrow(label, LABELS)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of shingles that two sets share."""
    m = len(sets)
    out = np.zeros((m, m))
    np.fill_diagonal(out, [len(s) for s in sets])
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, name, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[name] > 1  # a shingle of one set alone is in no intersection
    if not shared.any():
        return out
    column = np.unique(name[shared], return_inverse=True)[1]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(1, (1 << 22) // m)
    total = np.zeros((m, m))
    for low in range(0, int(column[-1]) + 1, step):
        a, b = np.searchsorted(column, [low, low + step])
        has = np.zeros((m, step), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        total += has @ has.T
    np.fill_diagonal(total, out.diagonal())
    return total


def linked(
    sets: list[np.ndarray], nodes: np.ndarray, part: np.ndarray, tree: int, inside: bool, threshold: float
) -> np.ndarray:
    """Which pairs of a block are similar and meet in no earlier tree. Texts of one part meet in the block
    `inside` that part alone, those of two parts in the block across them, where one part may have no texts."""
    if not inside and part.min() == part.max():
        return np.zeros((len(sets), len(sets)), bool)
    common = _common(sets)
    sizes = common.diagonal()
    out = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    if not inside:
        out &= part[:, None] != part[None, :]
    np.fill_diagonal(out, False)
    a, b = np.nonzero(out)
    if tree and len(a):
        earlier = np.zeros(len(a), bool)
        for t in range(tree):
            earlier |= nodes[a, t] == nodes[b, t]
        out[a[earlier], b[earlier]] = False
    return out


def _roots(out: np.ndarray) -> np.ndarray:
    """For every text of a block the first one it is connected with."""
    root = np.arange(len(out))
    while True:
        least = np.where(out, root[None, :], len(out)).min(axis=1, initial=len(out))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


LINKS = "item binary, other binary, links bigint"
BLOCK = ["tree", "node", "low", "high"]


def _verify(threshold: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        key: tuple | None = None
        held: list[tuple] = []

        def block() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            items, copies, part, nodes, sets = zip(*held)
            out = linked(list(sets), np.array(nodes), np.array(part), key[0], key[2] == key[3], threshold)
            some = np.flatnonzero(out.any(axis=1))
            if not len(some):
                return None
            links = out @ np.array(copies)
            root = _roots(out)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([items[k] for k in some], pa.binary()),
                    pa.array([items[root[k]] for k in some], pa.binary()),
                    pa.array(links[some], pa.int64()),
                ],
                ["item", "other", "links"],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in BLOCK)))
            items, copies, part = (batch.column(c).to_pylist() for c in ("item", "copies", "part"))
            nodes = batch.column("nodes").flatten().to_numpy().reshape(len(keys), -1)
            for row, shingles in shingle_sets((t.as_py() for t in batch.column("text")), hasher, size):
                if keys[row] != key:
                    if (done := block()) is not None:
                        yield done
                    key, held = keys[row], []
                held.append((items[row], copies[row], part[row], nodes[row], shingles))
        if (done := block()) is not None:
            yield done

    return run


def links(docs: DataFrame, threshold: float, recall: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(labels of all texts: doc_id, tag, item; similar shingle sets: item, other, links).

    Each item with a link comes with an item it is connected with, and the number of documents of other
    shingle sets it is similar to; an item may have several rows. Both are written when this is called.
    """
    depth = prefix_length(threshold, recall)
    texts = keyed_texts(docs)
    known = stored(labels(texts, TREES, depth, size), "labels")
    # Copies of one shingle set leave each task as one row.
    reps = known.groupBy("item").agg(
        F.min(F.struct("doc_id", "tag")).alias("r"),
        F.count("*").alias("copies"),
        F.first("shingles").alias("shingles"),
        F.first("nodes").alias("nodes"),
    )
    reps = stored(reps.select("item", "r.doc_id", "r.tag", "copies", "shingles", "nodes"), "shingle-sets")

    at = reps.select("item", "shingles", F.posexplode("nodes").alias("tree", "node"))
    # Nodes with the same texts, in whatever trees, are compared once, in the first tree.
    same = F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64("item", F.lit(1)))
    nodes = at.groupBy("tree", "node").agg(
        F.count("*").alias("n"), F.sum("shingles").alias("held"), same[0].alias("s0"), same[1].alias("s1")
    )
    nodes = nodes.filter("n > 1").groupBy("n", "held", "s0", "s1").agg(F.min(F.struct("tree", "node")).alias("at"))
    chunks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("held") / BLOCK_SHINGLES)).cast("int")
    nodes = nodes.select("at.tree", "at.node", chunks.alias("chunks"))
    members = at.join(nodes, ["tree", "node"]).select(
        "tree", "node", "item", "chunks", F.pmod(F.xxhash64("item", "tree"), F.col("chunks")).cast("int").alias("part")
    )
    members = stored(members, "members", heavy=True)
    # A text meets each chunk of its node in one block.
    pairs = members.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "tree", "node", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"), "part", "item"
    )
    wanted = reps.join(members.select("item").distinct(), "item", "left_semi")
    wanted = wanted.join(texts, ["doc_id", "tag"]).select("item", "copies", "nodes", "text").dropDuplicates(["item"])
    blocks = pairs.join(wanted, "item").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = blocks.select(*BLOCK, "part", "item", "copies", "nodes", "text").mapInArrow(_verify(threshold, size), LINKS)
    return known.select("doc_id", "tag", "item"), stored(found, "links", heavy=True)


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = WORDS
) -> DataFrame:
    """doc_id, tag, class_id, n_links of every row with an id; tag is a hash of the text.

    class_id is the least doc_id among all documents that chains of similar documents connect. n_links counts
    the other documents whose shingles have a Jaccard similarity of at least `threshold`, copies included. A
    text without words, null ones too, is similar to none; one of fewer than `size` words is a single
    shingle. Repeated rows count as copies. Rows without an id are left out. Only doc_id and text are read.
    """
    known, found = links(docs, threshold, recall, size)
    roots = components(found.select(F.col("item").alias("a"), F.col("other").alias("b")))
    per_item = found.groupBy("item").agg(F.sum("links").alias("links"))
    items = known.groupBy("item").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    items = items.join(per_item, "item", "left").join(roots.select(F.col("a").alias("item"), "b"), "item", "left")
    items = stored(items.withColumn("root", F.coalesce("b", "item")).drop("b"), "items")
    least = items.groupBy("root").agg(F.min("least").alias("class_id"))
    placed = items.join(least, "root").select(
        "item", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = known.join(placed, "item").select("doc_id", "tag", "class_id", "n_links")
    silent = keyed_texts(docs).filter(~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return out.unionByName(
        silent.select("doc_id", "tag", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    )


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row; see classes. A row without an id has no class and no links."""
    unnamed = docs.filter("doc_id IS NULL").select(
        F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return classes(docs, threshold, recall).drop("tag").unionByName(unnamed)


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, unchanged, of one document of each class: the one with the least doc_id.

    Rows without an id stay. Of rows that share id and text one stays, whatever their other columns; different
    texts of one id are documents of their own, and where they share the least id of a class all of them stay.
    """
    kept = classes(docs, threshold, recall).filter("doc_id = class_id").select("doc_id", "tag").distinct()
    # The caller's row travels as one column, so none of its names can meet a name used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rank = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("rank")
    named = docs.filter("doc_id IS NOT NULL")
    tagged = named.select(F.col("doc_id").cast("bigint").alias("id"), text_tag().alias("key"), row, rank)
    # A text leaves each task once, so one that is repeated very often fills no task.
    one = tagged.groupBy("id", "key").agg(F.min_by("row", "rank").alias("row"))
    one = one.join(kept.select(F.col("doc_id").alias("id"), F.col("tag").alias("key")), ["id", "key"], "left_semi")
    return one.select("row.*").unionByName(docs.filter("doc_id IS NULL"))
