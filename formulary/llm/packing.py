"""Packing documents into sequences by bin completion.

Pieces of equal length are interchangeable, so the packing is planned for counts per length: at most one
number for each length up to the size of a sequence, however many documents there are. Around the longest
piece left, undominated fillings of the room beside it are listed, the best is taken as often as the counts
allow, and branch and bound over these choices, with the best-fit plan as its first incumbent, stops at the lower
bound or at a number of nodes. Pieces then find their place in the plan by their number within their length.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from formulary.llm.tables import numbered

SIZE = 1024
END = 2  # id after every document
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"  # the one string that the vocabulary treats apart
NODES = 1_000  # nodes of the search beyond its first plan; whatever is best by then is used
WIDTH = 4  # fillings tried around one longest piece
STEPS = 400  # steps to list the fillings of one room


# -- token ids -------------------------------------------------------------------------------------


@cache
def _fast(ranks: str):
    """The encoder of a rank table, loaded once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@cache
def _full(vocabulary: str):
    """The full tokenizer, loaded only in a Python worker that meets a text which needs it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def token_ids(text: str | None, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> np.ndarray:
    """The ids of a text, without special tokens added, and END after them.

    The rank table holds the same vocabulary and gives the same ids several times faster; texts with the
    special string, and those that its pattern matcher gives up on, go to the full tokenizer.
    """
    text = text or ""
    ids = None
    if SPECIAL not in text:
        try:
            ids = _fast(ranks).encode_ordinary(text)
        except BaseException as e:  # the matcher's panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    if ids is None:
        ids = _full(vocabulary).encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, END
    return out


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, the first piece may be shorter."""
    first = length if length <= size else length % size or size
    return [(0, first)] + [(start, size) for start in range(first, length, size)]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text; no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, made = [], [array("q") for _ in range(4)]
            for k, text in enumerate(batch.column("text")):
                ids = token_ids(text.as_py(), vocabulary, ranks)
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    row.append(k)
                    part = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(made, (piece, start, length, part)):
                        column.append(value)
            piece, start, length, part = (np.frombuffer(column, np.int64) for column in made)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece.astype(np.int32))]
            columns += [pa.array(x) for x in (start, length, part)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, PIECES)


# -- the plan --------------------------------------------------------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of `b` fit into the pieces of `a`, so that `a` leaves the better rest."""
    rooms = sorted((length for length, n in a for _ in range(n)), reverse=True)
    if sum(n for _, n in b) < len(rooms):
        return False
    for length, n in b:
        for _ in range(n):
            fits = [k for k, room in enumerate(rooms) if room >= length]
            if not fits:
                return False
            tight = min(fits, key=rooms.__getitem__)
            rooms[tight] -= length
    return True


def fillings(counts: list[int], room: int, width: int = WIDTH, steps: int = STEPS) -> list[Filling]:
    """Up to `width` undominated fillings of `room` from `counts` pieces per length, least waste first.

    Longest pieces come first, so the greedy filling is always among the listed ones. Listing ends after
    `width` fillings without waste or after `steps` steps.
    """
    if room and room < len(counts) and counts[room]:
        return [((room, 1),)]  # fills the room alone and so dominates every other filling
    present = [length for length in range(min(room, len(counts) - 1), 0, -1) if counts[length] > 0]
    if not present:
        return [()]
    found: list[tuple[int, int, Filling]] = []
    exact, left, least = 0, steps, present[-1]

    def walk(k: int, room: int, held: Filling, n: int) -> None:
        nonlocal exact, left
        left -= 1
        if room < least:
            found.append((room, n, held))
            exact += room == 0
            return
        stuck = True
        for j in range(k, len(present)):
            length = present[j]
            if length > room:
                continue
            stuck = False
            for m in range(min(counts[length], room // length), 0, -1):
                walk(j + 1, room - m * length, (*held, (length, m)), n + m)
                if left <= 0 or exact >= width:
                    return
        if stuck:
            found.append((room, n, held))

    walk(0, room, (), 0)
    found.sort(key=lambda f: (f[0], f[1], [-length for length, _ in f[2]]))
    out: list[Filling] = []
    for _, _, filling in found[: 4 * width]:
        if not any(dominates(kept, filling) for kept in out):
            out.append(filling)
        if len(out) == width:
            break
    return out


Pattern = tuple[Filling, int]  # pieces of a sequence, and how many sequences are like it


def _apply(counts: list[int], filling: Filling) -> int:
    """Takes as many sequences of one filling as the counts allow."""
    times = min(counts[length] // n for length, n in filling)
    for length, n in filling:
        counts[length] -= n * times
    return times


def _around(longest: int, filling: Filling) -> Filling:
    """The filling with the longest piece itself."""
    if filling and filling[0][0] == longest:
        return ((longest, filling[0][1] + 1), *filling[1:])
    return ((longest, 1), *filling)


def best_fit(counts: list[int], size: int = SIZE) -> list[Pattern]:
    """Every piece, longest first, into the fullest sequence that still has room for it.

    Sequences of one filling are kept as one group. A sequence that takes a piece is then the fullest one, so it
    goes on to take as many of that length as it has room for.
    """
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    for length in range(size, 0, -1):
        left = counts[length] if length < len(counts) else 0
        if not left:
            continue
        gained: list[tuple[int, Filling, int]] = []

        def fill(held: Filling, room: int, times: int) -> None:
            """Up to `times` sequences of one filling take what is left."""
            nonlocal left
            each = room // length
            whole = min(times, left // each)
            if whole:
                gained.append((room - each * length, (*held, (length, each)), whole))
                left -= whole * each
            if left and whole < times:
                gained.append((room - left * length, (*held, (length, left)), 1))
                whole, left = whole + 1, 0
            if whole < times:
                gained.append((room, held, times - whole))

        for room in sorted(r for r in rooms if r >= length):
            if not left:
                break
            for held, times in rooms.pop(room):
                if left:
                    fill(held, room, times)
                else:
                    gained.append((room, held, times))
        if left:
            fill((), size, -(-left // (size // length)))
        for room, held, times in gained:
            rooms.setdefault(room, []).append((held, times))
    return [group for groups in rooms.values() for group in groups]


def plan(counts: list[int], size: int = SIZE, nodes: int = NODES) -> list[Pattern]:
    """Sequences for `counts[length]` pieces of each length up to `size`, as few as the search finds.

    The best-fit plan is the first incumbent. The search goes down once, and ends `nodes` nodes after that, or as
    soon as the lower bound is met. Work and result depend on the number of different lengths, not on the counts.
    """
    total = sum(length * n for length, n in enumerate(counts))
    bound = -(-total // size)
    best = best_fit(counts, size)
    best_n = sum(times for _, times in best)
    # Depth first: a level is (fillings not tried yet, counts before it, sequences and patterns so far).
    stack: list[tuple[list[Filling], list[int], int, int]] = []
    taken: list[Pattern] = []
    at, used, waste = list(counts), 0, 0
    top = size
    spent, down = 0, True
    while True:
        while top > 0 and at[top] == 0:
            top -= 1
        dead = waste > (best_n - 1) * size - total
        if not dead and top == 0:
            if used < best_n:
                best, best_n = list(taken), used
            dead = True
        down = down and not dead
        if best_n == bound or spent >= nodes:
            return best
        if not dead:
            spent += not down
            at[top] -= 1
            options = fillings(at, size - top)
            at[top] += 1
            options = [_around(top, f) for f in options]
            stack.append((options[1:], list(at), used, waste))
            choice = options[0]
        else:
            while stack and not stack[-1][0]:
                stack.pop()
                taken.pop()
            if not stack:
                return best
            options, before, used, waste = stack.pop()
            taken.pop()
            at = list(before)
            choice = options[0]
            stack.append((options[1:], before, used, waste))
        times = _apply(at, choice)
        taken.append((choice, times))
        used += times
        waste += times * (size - sum(length * n for length, n in choice))
        top = size


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first number, sequences, first sequence, offset): where the pieces of a length go.

    Pieces number `first + j * sequences + i` lie in sequence `first sequence + i` at `offset + j * length`.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    numbers: dict[int, int] = {}
    sequence = 0
    for filling, times in patterns:
        offset = 0
        for length, n in filling:
            first = numbers.get(length, 0)
            out.setdefault(length, []).append((first, times, sequence, offset))
            numbers[length] = first + n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def packed(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null text is an empty one: its only id is END. Repeated rows and rows without an id are packed like any
    other. Only doc_id and text are read. Pieces, without their ids, are written when this is called, and at
    most `size` counts reach the driver.
    """
    rows = numbered(pieces(docs, size, vocabulary, ranks), ["length"], "number")
    counts = [0] * (size + 1)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    where = places(plan(counts, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                chosen = np.flatnonzero(lengths == length)
                table = where[int(length)]
                row = table[np.searchsorted(table[:, 0], numbers[chosen], side="right") - 1]
                past = numbers[chosen] - row[:, 0]
                sequence[chosen] = row[:, 2] + past % row[:, 1]
                offset[chosen] = row[:, 3] + past // row[:, 1] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").cast("bigint")).mapInArrow(
        place, PIECES + ", sequence_id bigint, offset bigint"
    )
