"""Vectors as codes of their parts: codebooks learnt over metric trees that cache sums and counts.

Every task cuts its vectors into shards and builds one tree of balls per part and shard by the anchors
hierarchy, middle out: about as many anchors as the square root of the points are placed, each new one on the
point farthest from its own anchor and taking over what lies nearer to it; balls around them are merged in
pairs up to the root, and split by anchors of their own down to the leaves. A tree is built once and written.
Each round sends the codebooks (a few numbers) to the trees: a ball inherits the entries that its parent
could not rule out and drops those farther than another for all of its points; a ball left with one entry
gives its cached sum and count as a whole. All arithmetic on results is in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from formulary.llm.tables import stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
SHARD_ROWS = 2048  # vectors whose trees lie in one row
LEAF = 24  # points of a ball that is not split
REACH = 1 << 26  # whole numbers stay below this, so that all sums of squares fit into 64 bits
MAX_BROADCAST_LABELS = 10_000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of `a` to each row of `b`."""
    d = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def anchored(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows of about sqrt(len(rows)) anchors: at least two, unless all points are equal."""
    held = points[rows].astype(np.float64)
    owner = np.zeros(len(rows), np.int64)
    reach = np.sqrt(((held - held[0]) ** 2).sum(1))
    anchors = [0]
    while len(anchors) < max(2, round(len(rows) ** 0.5)):
        new = int(reach.argmax())
        if reach[new] == 0:
            break
        apart = np.sqrt(((held[anchors] - held[new]) ** 2).sum(1))
        # A point less than half as far from its anchor as that is from the new one cannot be nearer to this.
        asked = np.flatnonzero(2 * reach >= apart[owner])
        found = np.sqrt(((held[asked] - held[new]) ** 2).sum(1))
        nearer = found < reach[asked]
        owner[asked[nearer]] = len(anchors)
        reach[asked[nearer]] = found[nearer]
        anchors.append(new)
    return [rows[owner == k] for k in range(len(anchors))]


def merged(points: np.ndarray, balls: list[tuple]) -> tuple:
    """Balls (rows, node) joined in pairs, those first whose common ball is smallest, until one is left."""
    centres = np.array([points[rows].mean(0) for rows, _ in balls])
    radii = np.array([np.sqrt(((points[rows] - c) ** 2).sum(1).max()) for (rows, _), c in zip(balls, centres)])
    counts = np.array([len(rows) for rows, _ in balls], np.float64)
    nodes = [node for _, node in balls]

    def spans(k: int) -> np.ndarray:
        apart = np.sqrt(((centres - centres[k]) ** 2).sum(1))
        return np.maximum((apart + radii + radii[k]) / 2, np.maximum(radii, radii[k]))

    width = np.array([spans(k) for k in range(len(nodes))])
    np.fill_diagonal(width, np.inf)
    for _ in range(len(nodes) - 1):
        a, b = divmod(int(width.argmin()), len(nodes))
        nodes[a] = (nodes[a], nodes[b])
        radii[a] = width[a, b]
        centres[a] = (centres[a] * counts[a] + centres[b] * counts[b]) / (counts[a] + counts[b])
        counts[a] += counts[b]
        width[b, :] = width[:, b] = np.inf
        live = np.isfinite(width[a])
        width[a, live] = width[live, a] = spans(a)[live]
    return nodes[a] if len(nodes) > 1 else nodes[0]


def middle_out(points: np.ndarray, rows: np.ndarray):
    """A leaf as its rows, any other ball as a pair."""
    if len(rows) <= LEAF:
        return rows
    groups = anchored(points, rows)
    if len(groups) == 1:
        return rows
    return merged(points, [(g, middle_out(points, g)) for g in groups])


@dataclass
class Balls:
    """A tree as flat arrays. Node 0 is the root; a ball holds the points lo to hi of `order`."""

    order: np.ndarray  # row of each place
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray  # -1 in a leaf
    right: np.ndarray
    radius: np.ndarray
    total: np.ndarray  # sum of the points

    FIXED = ("lo", "hi", "left", "right")

    @classmethod
    def build(cls, points: np.ndarray) -> Balls:
        order: list[np.ndarray] = []
        lo, hi, left, right = [], [], [], []
        at, todo = 0, [(middle_out(points, np.arange(len(points))), -1, False)]
        while todo:
            node, parent, is_right = todo.pop()
            me = len(lo)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            lo.append(at)
            left.append(-1)
            right.append(-1)
            if isinstance(node, tuple):
                hi.append(-1)
                todo += [(node[1], me, True), (node[0], me, False)]
            else:
                order.append(node)
                at += len(node)
                hi.append(at)
        for k in range(len(lo) - 1, -1, -1):  # children stand behind their parents
            if left[k] >= 0:
                hi[k] = hi[right[k]]
        placed = np.concatenate(order)
        held = points[placed]
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(held, 0)])
        total = sums[hi] - sums[lo]
        centre = total / (np.array(hi) - np.array(lo))[:, None]
        radius = np.array([np.sqrt(((held[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(lo, hi, centre)])
        return cls(placed, *(np.array(x) for x in (lo, hi, left, right)), radius, total)

    def pack(self) -> bytes:
        sizes = np.array([len(self.order), len(self.lo)], np.int32)
        small = [np.asarray(x, np.int32) for x in (self.order, self.lo, self.hi, self.left, self.right)]
        return b"".join(x.tobytes() for x in (sizes, *small, self.radius, self.total))

    @classmethod
    def unpack(cls, data: bytes, dims: int) -> Balls:
        n, k = np.frombuffer(data, np.int32, 2).tolist()
        at, parts = 8, []
        for kind, size in [(np.int32, n), *[(np.int32, k)] * 4, (np.float64, k), (np.int64, k * dims)]:
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(*parts[:-1], parts[-1].reshape(k, dims))


def owners(tree: Balls, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each place, sum and number of the points of each entry); ties to the lower entry.

    `points` are in the tree's order.
    """
    owner = np.zeros(len(points), np.int16)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    between = np.sqrt(_squares(entries, entries).astype(np.float64))
    # An entry equal to a lower one owns nothing.
    first = ~np.tril(between == 0, -1).any(1)
    nodes, asked = np.array([0]), first[None, :]
    open_nodes, open_asked = [], []
    while len(nodes):
        size = (tree.hi[nodes] - tree.lo[nodes]).astype(np.int64)
        far = np.where(asked, _squares(tree.total[nodes] / size[:, None], entries.astype(np.float64)), np.inf)
        best = far.argmin(1)
        least = far[np.arange(len(nodes)), best]
        # For no point of the ball can the difference of the two squared distances shrink by more than `slack`.
        slack = 2 * tree.radius[nodes][:, None] * between[best] * (1 + 1e-9)
        with np.errstate(invalid="ignore"):
            asked = asked & (far - least[:, None] <= slack + 1e-9 * (far + least[:, None]) + 1e-3)
        whole = asked.sum(1) == 1
        np.add.at(sums, best[whole], tree.total[nodes[whole]])
        np.add.at(counts, best[whole], size[whole])
        for node, b in zip(nodes[whole].tolist(), best[whole].tolist()):
            owner[tree.lo[node] : tree.hi[node]] = b
        leaf = ~whole & (tree.left[nodes] < 0)
        open_nodes.append(nodes[leaf])
        open_asked.append(asked[leaf])
        inner = ~whole & ~leaf
        nodes = np.concatenate([tree.left[nodes[inner]], tree.right[nodes[inner]]])
        asked = np.concatenate([asked[inner], asked[inner]])
    nodes, asked = np.concatenate(open_nodes), np.concatenate(open_asked)
    size = (tree.hi[nodes] - tree.lo[nodes]).astype(np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(tree.lo[nodes], size) + within
    far = np.where(np.repeat(asked, size, 0), _squares(points[place], entries), np.iinfo(np.int64).max)
    own = far.argmin(1)
    owner[place] = own
    np.add.at(sums, own, points[place])
    np.add.at(counts, own, 1)
    return owner, sums, counts


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (doubles) and label of rows whose vector is not null and has no null or non-finite component."""
    bad = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), "label")
    return rows.selectExpr("vec_id", f"CASE WHEN NOT {bad} THEN embedding END AS vec", "label").filter("vec IS NOT NULL")


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """parts x entries x components of a part: the vectors of the smallest ids; None without any vector."""
    whole = rows.filter(f"size(vec) > 0 AND size(vec) % {parts} = 0")
    order = [F.col("vec_id").asc_nulls_last(), "vec"]
    least = whole.orderBy(*order).select("vec").first()
    if least is None:
        return None
    same = whole.filter(F.size("vec") == len(least.vec)).orderBy(*order).select("vec").limit(entries).collect()
    numbers = whole_numbers(np.array([r.vec for r in same], np.float64))
    return np.swapaxes(numbers.reshape(len(same), parts, -1), 0, 1).copy()


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    out = np.floor(vectors * SCALE)
    if len(out) and np.abs(out).max() >= REACH:
        raise OverflowError(f"a component of {REACH // SCALE} or more in size")
    return out.astype(np.int64)


def _label_type(vectors: DataFrame) -> T.DataType:
    return vectors.schema["label"].dataType


def planted(rows: DataFrame, parts: int, dims: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: ids and labels of its vectors, their numbers as bytes, and a tree for each part.

    The shards are cut from what a task reads, without a shuffle; no result depends on where.
    """
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(_label_type(rows))),
            T.StructField("numbers", T.BinaryType()),
            T.StructField("trees", T.ArrayType(T.BinaryType())),
        ]
    )

    def one(shard: pa.Table) -> pa.RecordBatch:
        held = shard.combine_chunks()
        vectors = held["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        numbers = whole_numbers(vectors)
        width = dims // parts
        trees = [Balls.build(numbers[:, p * width : (p + 1) * width]).pack() for p in range(parts)]
        ends = pa.array([0, len(numbers)], pa.int32())
        columns = [pa.ListArray.from_arrays(ends, held[c].combine_chunks()) for c in ("vec_id", "label")]
        columns += [pa.array([numbers.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            fit = pc.equal(pc.list_value_length(batch.column("vec")), dims)
            held.append(batch.filter(fit))
            while sum(b.num_rows for b in held) >= shard_rows:
                table = pa.Table.from_batches(held)
                yield one(table.slice(0, shard_rows))
                held = table.slice(shard_rows).to_batches()
        if any(b.num_rows for b in held):
            yield one(pa.Table.from_batches(held))

    return stored(rows.mapInArrow(run, schema), "metric-trees")


def _shards(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[int, list[Balls], np.ndarray]]:
    """(row, the trees of all parts, the numbers) of each shard."""
    for k in range(batch.num_rows):
        numbers = np.frombuffer(batch.column("numbers")[k].as_buffer(), np.int32).reshape(-1, parts * width)
        trees = [Balls.unpack(tree.as_buffer(), width) for tree in batch.column("trees")[k].values]
        yield k, trees, numbers.astype(np.int64)


def next_codebooks(shards: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the rounded-down mean of its parts. Tasks send one sum per entry and component."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place of an entry counts its parts.
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for _, trees, numbers in _shards(batch, parts, width):
                for p, tree in enumerate(trees):
                    points = numbers[tree.order, p * width : (p + 1) * width]
                    _, total, count = owners(tree, points, books[p])
                    sums[p, :, :width] += total
                    sums[p, :, width] += count
        at = np.indices(sums.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(sums.ravel())], ["part", "entry", "at", "value"])

    found = shards.select("numbers", "trees").mapInArrow(run, "part int, entry int, at int, value bigint")
    # At most parts x entries x (width + 1) rows, however many vectors there are.
    rows = found.groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((parts, entries, width + 1), np.int64)
    for r in rows:
        sums[r.part, r.entry, r.at] = r.value
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)


def encoded(shards: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances, summed) of every vector."""
    parts, _, width = books.shape
    label = shards.schema["labels"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", label),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, trees, numbers in _shards(batch, parts, width):
                codes = np.zeros((len(numbers), parts), np.uint8)
                error = np.zeros(len(numbers), np.int64)
                for p, tree in enumerate(trees):
                    own = numbers[:, p * width : (p + 1) * width]
                    codes[tree.order, p] = owners(tree, own[tree.order], books[p])[0]
                    error += ((own - books[p][codes[:, p]]) ** 2).sum(1)
                digits = codes.tobytes().hex()
                text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], schema.names)

    return shards.mapInArrow(run, schema)


def learned(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, shard_rows: int = SHARD_ROWS
) -> tuple[DataFrame, np.ndarray] | None:
    """(written shards with their trees, codebooks after `rounds` rounds); None where no vector takes part."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = usable(vectors)
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return None
    shards = planted(rows, parts, parts * books.shape[2], shard_rows)
    for _ in range(rounds):
        books = next_codebooks(shards, books)
    return shards, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part.

    No part takes a vector that is null or holds a null or non-finite component, that is empty or whose length
    is no multiple of `parts`, or whose length differs from that of the least vec_id left. Rows without an id come
    last among the ids and keep a null one; rows that share an id, and repeated rows, count each, ordered by id
    and then vector. Fewer vectors than `entries` give as many entries. Ties go to the lower entry; an entry that
    nothing is nearest to stays. label_error sums the error over equal labels, nulls together. A component of
    16384 or more in size raises an error, as sums might not fit into 64 bits. An empty table gives no rows. Only
    vec_id, embedding and label are read. Trees, rounds and codes are computed and written when this is called.
    """
    made = learned(vectors, parts, entries, rounds, shard_rows)
    if made is None:
        names = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], names)
    shards, books = made
    rows = stored(encoded(shards, books), "codes")
    # Written down, so that Spark can split the rows of a label that many vectors share.
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = stored(sums.withColumnRenamed("label", "of"), "label-errors")
    if sums.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
