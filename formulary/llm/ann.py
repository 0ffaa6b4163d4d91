"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Vectors that are equal, or differ by a power of two, are indexed once, so a vector that is repeated very often cannot fill a neighbourhood. A
graph is stored as flat arrays. Every query meets every shard, in blocks of queries, and the results of
the shards are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from formulary.llm.tables import stored

SHARD_ROWS = 4000  # vectors of a shard, about
BLOCK_QUERIES = 1000  # queries of a block, about
LINKS = 16  # neighbours kept on each level, twice as many on the lowest
BEAM_BUILD, BEAM_SEARCH = 100, 100
GRAPH = "shard int, members binary, leasts binary, vectors binary, dims int, levels binary, links binary, entry int"
CLOSE = 1e-6  # closeness in single precision may be wrong by less


class Graph:
    """A graph over the rows of `vectors` (unit length, float32), as flat arrays.

    `links[offset[i] + ...]` holds the neighbours of row i: 2 * LINKS places for level 0, then LINKS for
    each higher level; -1 marks a free place.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: np.ndarray | None = None, entry: int = -1):
        self.vectors, self.levels, self.entry = vectors, levels, entry
        sizes = LINKS * (2 + levels.astype(np.int64))
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.links = np.full(self.offset[-1], -1, np.int32) if links is None else links
        self.seen = np.zeros(len(vectors), np.int64)
        self.stamp = 0

    def _place(self, row: int, level: int) -> tuple[int, int]:
        start = int(self.offset[row])
        return (start, 2 * LINKS) if level == 0 else (start + LINKS * (level + 1), LINKS)

    def neighbours(self, row: int, level: int) -> np.ndarray:
        start, size = self._place(row, level)
        found = self.links[start : start + size]
        return found[found >= 0]

    def _beam(self, query: np.ndarray, entries: list[tuple[float, int]], level: int, width: int) -> list:
        """The `width` rows nearest to `query` that a best-first walk on one level reaches: (closeness, row)."""
        self.stamp += 1
        seen, stamp = self.seen, self.stamp
        for _, row in entries:
            seen[row] = stamp
        ahead = [(-c, row) for c, row in entries]
        best = list(entries)
        heapq.heapify(ahead)
        heapq.heapify(best)
        while ahead:
            closeness, row = heapq.heappop(ahead)
            if len(best) >= width and -closeness < best[0][0]:
                break
            near = self.neighbours(row, level)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for c, other in zip((self.vectors[near] @ query).tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (c, other))
                    heapq.heappush(ahead, (-c, other))
                elif c > best[0][0]:
                    heapq.heapreplace(best, (c, other))
                    heapq.heappush(ahead, (-c, other))
        return best

    def _spread(self, candidates: list[tuple[float, int]], size: int) -> list[int]:
        """Up to `size` candidates, nearest first, each nearer to the row than to one chosen before; filled up."""
        ranked = sorted(candidates, reverse=True)
        if len(ranked) <= size:
            return [row for _, row in ranked]
        rows = np.array([row for _, row in ranked])
        between = self.vectors[rows] @ self.vectors[rows].T
        chosen: list[int] = []
        for k, (c, _) in enumerate(ranked):
            if not chosen or between[k, chosen].max() < c:
                chosen.append(k)
                if len(chosen) == size:
                    break
        if len(chosen) < size:
            taken = set(chosen)
            chosen += [k for k in range(len(ranked)) if k not in taken][: size - len(chosen)]
        return rows[chosen].tolist()

    def _connect(self, row: int, level: int, others: list[int]) -> None:
        start, size = self._place(row, level)
        self.links[start : start + len(others)] = others
        for other in others:
            start, size = self._place(other, level)
            held = self.links[start : start + size]
            free = int((held >= 0).sum())
            if free < size:
                self.links[start + free] = row
                continue
            rows = np.append(held, row)
            pairs = list(zip((self.vectors[rows] @ self.vectors[other]).tolist(), rows.tolist()))
            kept = self._spread(pairs, size)
            self.links[start : start + size] = kept + [-1] * (size - len(kept))

    def add(self, row: int) -> None:
        query, top = self.vectors[row], int(self.levels[row])
        if self.entry < 0:
            self.entry = row
            return
        at = [(float(self.vectors[self.entry] @ query), self.entry)]
        for level in range(int(self.levels[self.entry]), -1, -1):
            if level > top:
                at = [max(self._beam(query, at, level, 1))]
                continue
            at = self._beam(query, at, level, BEAM_BUILD)
            self._connect(row, level, self._spread(at, LINKS))
        if top > self.levels[self.entry]:
            self.entry = row

    def search(self, query: np.ndarray, k: int) -> np.ndarray:
        """The k rows nearest to the query that the walk has met, and those as near as the last but for rounding."""
        at = [(float(self.vectors[self.entry] @ query), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = [max(self._beam(query, at, level, 1))]
        best = self._beam(query, at, 0, max(BEAM_SEARCH, k))
        closeness, rows = (np.array(x) for x in zip(*best))
        last = np.sort(closeness)[-min(k, len(closeness))]
        return rows[closeness >= last - CLOSE]


def build(vectors: np.ndarray, heights: np.ndarray) -> Graph:
    """A graph of all rows; `heights` are uniform numbers in (0, 1] that decide the levels."""
    levels = np.minimum((-np.log(heights) / math.log(LINKS)).astype(np.int8), 12)
    graph = Graph(vectors, levels)
    for row in range(len(vectors)):
        graph.add(row)
    return graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: no null, zero or non-finite vector, no null id."""
    bad = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).selectExpr(
        "vec_id", f"CASE WHEN vec_id IS NOT NULL AND NOT {bad} AND exists(embedding, x -> x != 0) THEN embedding END vec"
    ).filter("vec IS NOT NULL")


def keyed(vectors: DataFrame) -> DataFrame:
    """`vectors` with a key that those share which are equal but for a power of two, or the sign of a zero.

    Their cosines are equal, digit by digit. The largest component becomes 1, which such vectors survive alike;
    what else their lengths differ in is kept.
    """
    # A column of its own, so that it is not worked out again for every component.
    sized = vectors.withColumn("largest", F.expr("array_max(transform(vec, x -> abs(x)))"))
    shape = F.expr("transform(vec, x -> IF(x = 0, 0D, x / largest))").alias("shape")
    rest = F.expr("largest / pow(2D, floor(log2(largest)))").alias("rest")
    return sized.withColumn("key", F.sha2(F.to_json(F.struct(shape, rest)), 256)).drop("largest")


def index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(one row per shard with its graph, the first `keep` ids of every different vector, number of shards).

    Both are written down: the graphs are built once, whatever is searched. All vectors must have one length;
    those of another length form shards of their own, and are never compared.
    """
    rows = keyed(vectors).dropDuplicates(["key", "vec_id"])
    # Spark keeps the first rows of each window already before the shuffle, so a vector that a third of the rows
    # share sends `keep` rows per task.
    first = Window.partitionBy("key").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= keep)
    members = stored(members, "hnsw-members")
    distinct = members.filter("place = 1")
    shards = max(1, math.ceil(distinct.count() / shard_rows))

    def graph(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        unit = _unit(np.array(rows["vec"].tolist(), dtype=np.float64))
        heights = rows["key"].map(lambda h: (int(h[16:28], 16) + 1) / 16.0**12).to_numpy()
        g = build(unit, heights)
        return pd.DataFrame(
            {
                "shard": [int(rows["shard"].iloc[0])],
                "members": ["".join(rows["key"]).encode()],
                "leasts": [rows["vec_id"].to_numpy(np.int64).tobytes()],
                "vectors": [np.array(rows["vec"].tolist(), dtype=np.float64).tobytes()],
                "dims": [unit.shape[1]],
                "levels": [g.levels.tobytes()],
                "links": [g.links.tobytes()],
                "entry": [g.entry],
            }
        )

    spread = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    sized = distinct.select("key", "vec_id", "vec", spread.alias("shard"), F.size("vec").alias("dims"))
    # Enough partitions that shards do not queue behind each other in one task.
    graphs = sized.repartition(shards, "shard", "dims").groupBy("shard", "dims").applyInPandas(graph, GRAPH)
    return stored(graphs, "hnsw-graphs"), members.select("key", "vec_id", "place"), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` for every row of `queries`, itself left out.

    score is the cosine of the original vectors in double precision; ties go to the smaller vec_id. Fewer
    than k other rows give fewer results. Vectors that are null, zero or hold a null or non-finite component
    take no part on either side, nor do rows without an id; an empty table gives no rows. Repeated rows count
    once; the vectors of a repeated vec_id all count, and each pair of ids has its best score.
    Only the columns vec_id and embedding are read. Graphs are built when this is called.
    """
    graphs, members, shards = index(usable(vectors), k + 1, shard_rows)
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("dims", F.size("query"))
    # A graph meets each block of queries once: pairs of blocks, not pairs of rows.
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(stored: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "key": [], "least": [], "score": []}
        if len(stored) and len(block):
            s = stored.iloc[0]
            full = np.frombuffer(s["vectors"], np.float64).reshape(-1, int(s["dims"]))
            leasts = np.frombuffer(s["leasts"], np.int64)
            names = [s["members"][i : i + 64].decode() for i in range(0, len(s["members"]), 64)]
            g = Graph(
                _unit(full), np.frombuffer(s["levels"], np.int8), np.frombuffer(s["links"], np.int32), int(s["entry"])
            )
            lengths = np.linalg.norm(full, axis=1)
            for query_id, q in zip(block["query_id"], block["query"]):
                q = np.asarray(q, dtype=np.float64)
                found = g.search((q / np.linalg.norm(q)).astype(np.float32), k + 1)
                scores = full[found] @ q / (lengths[found] * np.linalg.norm(q))
                first = np.lexsort([leasts[found], -scores])[: k + 1]
                out["query_id"] += [query_id] * len(first)
                out["key"] += [names[i] for i in found[first]]
                out["least"] += leasts[found[first]].tolist()
                out["score"] += scores[first].tolist()
        return pd.DataFrame(out)

    pairs = (
        left.groupBy("shard", "dims", "block")
        .cogroup(right.groupBy("shard", "dims", "block"))
        .applyInPandas(search, "query_id bigint, key string, least bigint, score double")
    )
    # k + 1 keys per query: one of them may be the query's own. Of equally near ones, those that hold smaller ids.
    closest = Window.partitionBy("query_id").orderBy(F.desc("score"), "least")
    short = pairs.withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= k + 1)
    named = short.join(members, "key").filter("vec_id != query_id")
    named = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
