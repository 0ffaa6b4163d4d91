"""Repeated passages over a length threshold, by seed and extend.

A passage of `size` words is a window. Winnowing picks one anchor (a run of `seed` words) in every window,
by the window's words alone, so equal windows have equal anchors. Documents are joined on their anchors;
only anchors that two documents share go on. Such a seed is extended to both sides over all windows that
picked it. Equal extensions match as a whole; where extensions of one anchor differ, their windows are
compared one by one. Matched windows that touch make up the maximal repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from formulary.llm.tables import stored

SIZE = 13  # words of a window
SEED = 4  # words of an anchor
CHUNK = 1 << 20  # bytes hashed at once

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self, step: np.uint64):
        self.step, self.size = step, 0

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > self.size:
            self.size = max(size, CHUNK + 4096)
            inverse = np.uint64(pow(int(self.step), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(self.size, self.step, np.uint64))
                self.inverse = np.cumprod(np.full(self.size, inverse, np.uint64))
        return self.power, self.inverse


class Runs:
    """Hashes of any runs of a sequence: polynomials modulo 2 ** 64, mixed afterwards."""

    def __init__(self, sequence: np.ndarray, powers: Powers):
        power, self.inverse = powers.upto(len(sequence))
        self.total = np.zeros(len(sequence) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(sequence * power[: len(sequence)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[ends] - self.total[starts]) * self.inverse[starts])


def split_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white space characters, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Hasher:
    """What a task needs to hash words and windows."""

    def __init__(self) -> None:
        self.bytes = Powers(BASE)
        self.words = Powers(STEPS[0]), Powers(STEPS[1])

    def of_words(self, line: bytes) -> np.ndarray:
        """One hash per word of `line`, whose words are parted by single spaces."""
        parts, at = [], 0
        while at < len(line):
            end = len(line)
            if end - at > CHUNK:
                end = line.find(b" ", at + CHUNK)
                end = len(line) if end < 0 else end
            data = np.frombuffer(line, np.uint8, end - at, at)
            spaces = np.flatnonzero(data == 32)
            runs = Runs(data.astype(np.uint64) + np.uint64(1), self.bytes)
            parts.append(runs(np.concatenate([[0], spaces + 1]), np.append(spaces, len(data))))
            at = end + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def portions(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row numbers, words of each row, hashes of all their words), about CHUNK bytes of text at once."""
        rows: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []
        size = 0
        for k, text in enumerate(texts):
            words = split_words(text)
            rows.append(k)
            counts.append(len(words))
            if words:
                held.append(b" ".join(words))
                size += len(held[-1])
            if size >= CHUNK:
                yield np.array(rows), np.array(counts), self.of_words(b" ".join(held))
                rows, counts, held, size = [], [], [], 0
        if rows:
            yield np.array(rows), np.array(counts), self.of_words(b" ".join(held))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` neighbouring values."""
    width, out = 1, values
    while width < size:
        step = min(width, size - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def anchors_of(words: np.ndarray, counts: np.ndarray, size: int, seed: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(row, anchor, extension, first window, windows) of the seeds of rows with `counts` words each.

    The anchor of a window is its least hash of `seed` words. A seed stands for a run of windows, one after
    the other and no longer than a window, that have the same anchor; its extension is a hash of all their words.
    """
    none = np.zeros(0, np.int64)
    if len(words) < size:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    n = len(words) - seed + 1
    grams = words[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, seed):
            grams *= STEPS[0]
            grams += words[k : k + n]
    least = _least(mixed(grams), size - seed + 1)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    inside = np.arange(len(least)) + size <= ends[row]
    new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1])
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    pieces = (stop - first + size - 1) // size  # repeated words make long runs; they are cut
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + piece * size
    stop = np.minimum(np.repeat(stop, pieces), first + size)
    window = Runs(words, hasher.words[1])
    with np.errstate(over="ignore"):
        one, two = window(first, first + size), window(stop - 1, stop - 1 + size)
        # The first and the last window of a run overlap or touch, so together they hold all its words.
        extension = mixed(mixed(one + (stop - first).astype(np.uint64) * BASE) * STEPS[0] + two)
    row = row[first]
    return row, least[first], extension, first - (ends - counts)[row], stop - first


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


# A place packs the first window and the number of windows of a run less one into a long.
RUN_BITS = 8
ANCHORS = "a bigint, e bigint, doc_id bigint, tag bigint, place bigint"


def _anchor_rows(size: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            for rows, counts, words in hasher.portions(t.as_py() for t in batch.column("text")):
                row, a, e, first, n = anchors_of(words, counts, size, seed, hasher)
                own = [pa.array(x[rows[row]]) for x in (ids, tags)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(a), _signed(e), *own, pa.array((first << RUN_BITS) | (n - 1))],
                    ["a", "e", "doc_id", "tag", "place"],
                )

    return run


def _window_rows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two hashes of every window of the runs listed in `open`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            runs = batch.column("open")
            for rows, counts, words in hasher.portions(t.as_py() for t in batch.column("text")):
                listed = runs.take(pa.array(rows))
                places = listed.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(rows)), listed.value_lengths().to_numpy(zero_copy_only=False))
                first = places >> RUN_BITS
                n = (places & ((1 << RUN_BITS) - 1)) + 1
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first, n) + within
                at = start + np.repeat((np.cumsum(counts) - counts)[row], n)
                one, two = (Runs(words, p)(at, at + size) for p in hasher.words)
                own = [pa.array(x[rows[np.repeat(row, n)]]) for x in (ids, tags)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(one), _signed(two), *own, pa.array(start << RUN_BITS)],
                    ["w1", "w2", "doc_id", "tag", "place"],
                )

    return run


def text_tag() -> Column:
    """64 bits that tell texts apart that share a doc_id; null is a text of its own."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text of the rows with an id."""
    return docs.select(F.col("doc_id").cast("bigint"), text_tag().alias("tag"), "text").filter("doc_id IS NOT NULL")


def repeats(
    docs: DataFrame, size: int = SIZE, seed: int = SEED, more: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, text and `more` columns by doc_id and tag; their repeats: doc_id, tag, start, length).

    A repeat is a run of words, here possibly touching or overlapping others of its text, all covered by
    windows of `size` words that also start in a text with a smaller doc_id. The shared anchors are found
    and written down when this is called.
    """
    if not 0 < seed <= size <= 1 << RUN_BITS:
        raise ValueError("seed and size must be at least 1 word, size at most 256, and seed no longer than size")
    texts = keyed_texts(docs)
    rows = texts.mapInArrow(_anchor_rows(size, seed), ANCHORS)
    ends = rows.groupBy("a").agg(
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        (F.min("e") != F.max("e")).alias("differ"),
    )
    # Written down, both sides of the join are plain exchanges, in which Spark splits a frequent anchor.
    ends = stored(ends.filter("lo < hi").select("a", "lo", "differ"), "anchors", heavy=True)
    shared = rows.join(ends, "a").filter("differ OR doc_id > lo")
    # Where all extensions of an anchor are equal, every document but the smallest repeats it.
    only = [F.when(F.col("differ"), F.col(c)).alias(c) for c in ("a", "e")]
    seeds = stored(shared.select(*only, "doc_id", "tag", "place", "differ"), "shared-anchors", heavy=True)

    # Of extensions that are equal among differing ones, the one in the smallest doc_id stays to be compared.
    differing = seeds.filter("differ").select("a", "e", "doc_id", "tag", "place")
    least = stored(differing.groupBy("a", "e").agg(F.min("doc_id").alias("least")), "extensions")
    runs = differing.join(least, ["a", "e"]).select(
        "doc_id", "tag", "place", (F.col("doc_id") > F.col("least")).alias("matched")
    )
    equal = seeds.filter("NOT differ").select("doc_id", "tag", "place", F.lit(True).alias("matched"))
    runs = stored(runs.unionByName(equal), "runs", heavy=True)

    named = docs.filter("doc_id IS NOT NULL")
    by_doc = named.select(F.col("doc_id").cast("bigint"), text_tag().alias("tag"), "text", *more)
    by_doc = by_doc.repartition("doc_id", "tag")
    open_runs = runs.filter("NOT matched").groupBy("doc_id", "tag").agg(F.collect_set("place").alias("open"))
    opened = by_doc.join(open_runs, ["doc_id", "tag"]).select("doc_id", "tag", "text", "open")
    windows = opened.mapInArrow(_window_rows(size), "w1 bigint, w2 bigint, doc_id bigint, tag bigint, place bigint")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    late = windows.join(least.filter("lo < hi").select("w1", "w2", "lo"), ["w1", "w2"]).filter("doc_id > lo")
    # Written down, so that the windows' shuffle files can go before the texts meet their repeats.
    late = stored(late.select("doc_id", "tag", "place"), "late-windows", heavy=True)
    matched = runs.filter("matched").select("doc_id", "tag", "place")
    found = matched.unionByName(late).select(
        "doc_id",
        "tag",
        F.shiftright("place", RUN_BITS).alias("start"),
        F.expr(f"(place & {(1 << RUN_BITS) - 1}) + {size}").alias("length"),
    )
    spans = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    return by_doc, spans.select("doc_id", "tag", "spans.start", "spans.length")


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def _spans_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    starts = batch.column("start")[k]
    if not starts.is_valid:
        return None
    return (
        starts.values.to_numpy(zero_copy_only=False),
        batch.column("length")[k].values.to_numpy(zero_copy_only=False),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest = [], [], []
        for k, text in enumerate(batch.column("text")):
            words = split_words(text.as_py())
            spans = _spans_of(batch, k)
            kept = words
            if spans is not None:
                kept = [w for w, gone in zip(words, covered(len(words), *spans).tolist()) if not gone]
            total.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeat_digests(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: what is left without its repeats.

    Removed is each word covered by a window of `size` words whose words also start in a text with a smaller
    doc_id. A null text has no words. A row without doc_id is neither smaller nor larger than others: nothing
    is removed from it or because of it. Rows that share a doc_id never remove words of each other, and
    repeated rows stay repeated. Texts shorter than a window stay whole. Only doc_id and text are read.
    """
    by_doc, spans = repeats(docs, size, seed)
    whole = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    joined = by_doc.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "start", "length")
    nothing = F.lit(None).cast("array<bigint>")
    unnamed = docs.filter("doc_id IS NULL").select(
        F.col("doc_id").cast("bigint"), "text", nothing.alias("start"), nothing.alias("length")
    )
    return joined.unionByName(unnamed).mapInArrow(_digests, whole)


BYTES_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the words marked as gone; what stays together keeps its white space."""
    data = text.encode("utf-8", "surrogatepass")
    at = np.array([m.span() for m in BYTES_WORD.finditer(data)])
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return ""
    first = np.flatnonzero(np.append(True, np.diff(kept) != 1))
    last = np.append(first[1:], len(kept)) - 1
    parts = [data[at[kept[a], 0] : at[kept[b], 1]] for a, b in zip(first, last)]
    return b" ".join(parts).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, text, lang, source and n_chars of `docs` without repeated passages of at least `size` words.

    What counts as repeated is as in repeat_digests. Where words go, n_chars is counted again; a text that
    loses all of its words goes as a row. All other rows stay as they are.
    """
    more = ["lang", "source", "n_chars"]
    by_doc, spans = repeats(docs, size, seed, more)
    joined = by_doc.join(spans, ["doc_id", "tag"], "left")
    columns = ["doc_id", "text", *more]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            keep = np.ones(len(texts), bool)
            for k, text in enumerate(texts):
                found = _spans_of(batch, k)
                if found is not None:
                    texts[k] = cut_text(text, covered(len(split_words(text)), *found))
                    sizes[k] = len(texts[k])
                    keep[k] = bool(texts[k])
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], columns)
            yield out.filter(pa.array(keep))

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    changed = joined.select(*columns, "start", "length").mapInArrow(cut, schema)
    return changed.unionByName(docs.filter("doc_id IS NULL").select(columns))
