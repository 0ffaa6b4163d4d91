"""Fill-in-the-middle texts by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text
and the sentinels. Cutting splits descriptors, an arrangement permutes them, the inverse permutation brings
them back, and hashes read the descriptors one after the other; text is copied only where it leaves a task.
Every row is worked on by itself, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
PLAIN_PERCENT, SPM_PERCENT = 10, 20  # texts left as they are; of the others, those with the suffix first
SALT = "1:"
STREAM = 1 << 16  # code points hashed at once
OUT_CHARS = 1 << 24  # code points of an Arrow batch that leaves a task, about
TEXT, MARKS = 0, 1  # the buffers

# The order of prefix, middle and suffix in each form, and the sentinel before each of them.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK_OF = (0, 2, 1)


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over a text and the joined sentinels."""

    def __init__(self, text: str, marks: str, pieces: Sequence[Piece] | None = None):
        self.buffers = (text, marks)
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else list(pieces)

    def with_pieces(self, pieces: Sequence[Piece]) -> PieceTable:
        return PieceTable(*self.buffers, pieces)

    def cut(self, at: int) -> PieceTable:
        """The descriptor that holds place `at` is split there; one part may be empty."""
        out, before = [], 0
        for k, p in enumerate(self.pieces):
            if at <= before + p.length:
                here = at - before
                parts = [Piece(p.buffer, p.start, here), Piece(p.buffer, p.start + here, p.length - here)]
                return self.with_pieces([*out, *parts, *self.pieces[k + 1 :]])
            out.append(p)
            before += p.length
        raise ValueError(f"no place {at} in {before} code points")

    def permuted(self, order: Sequence[int]) -> PieceTable:
        return self.with_pieces([self.pieces[i] for i in order])

    def restored(self, order: Sequence[int]) -> PieceTable:
        """What `permuted(order)` was made from."""
        out = list(self.pieces)
        for place, i in enumerate(order):
            out[i] = self.pieces[place]
        return self.with_pieces(out)

    def chunks(self) -> Iterator[str]:
        for p in self.pieces:
            held, end = self.buffers[p.buffer], p.start + p.length
            for at in range(p.start, end, STREAM):
                yield held[at : min(at + STREAM, end)]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.chunks():
            digest.update(part.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()

    def text(self) -> str:
        return "".join(self.chunks())


def _mark(sentinels: Sequence[str], k: int) -> Piece:
    return Piece(MARKS, sum(map(len, sentinels[:k])), len(sentinels[k]))


def arranged(table: PieceTable, form: str, sentinels: Sequence[str]) -> PieceTable:
    """Three descriptors, prefix, middle and suffix, in the order of `form`, each behind its sentinel."""
    order = FORMS[form]
    moved = table.permuted(order)
    pieces = [p for k, piece in zip(order, moved.pieces) for p in (_mark(sentinels, MARK_OF[k]), piece)]
    return moved.with_pieces(pieces)


def dissected(output: str, form: str, sentinels: Sequence[str]) -> PieceTable | None:
    """The three descriptors of an arranged text in their first order, or None where it is not of that form.

    The parts hold no sentinel of their own, so the first one found ends a part.
    """
    order = FORMS.get(form)
    marks = [sentinels[MARK_OF[k]] for k in order or ()]
    if not marks or not output.startswith(marks[0]):
        return None
    pieces, start = [], len(marks[0])
    for mark in marks[1:]:
        end = output.find(mark, start)
        if end < 0:
            return None
        pieces.append(Piece(TEXT, start, end - start))
        start = end + len(mark)
    return PieceTable(output, "", [*pieces, Piece(TEXT, start, len(output) - start)]).restored(order)


@dataclass(frozen=True)
class Plan:
    """How texts are cut and arranged: by the first 32 hex digits of sha256(salt and doc_id in decimals)."""

    sentinels: tuple[str, str, str] = SENTINELS
    plain_percent: int = PLAIN_PERCENT
    spm_percent: int = SPM_PERCENT
    salt: str = SALT

    def draws(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]

    def table(self, doc_id: int | None, text: str) -> tuple[str, PieceTable, int | None, int | None]:
        """(form, piece table of the output, code points of the prefix, of the middle)."""
        table = PieceTable(text, "".join(self.sentinels))
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or any(s in text for s in self.sentinels) or h3 % 100 >= 100 - self.plain_percent:
            return "plain", table, None, None
        first, last = sorted(h % (len(text) + 1) for h in (h1, h2))
        form = "spm" if h4 % 100 < self.spm_percent else "psm"
        return form, arranged(table.cut(first).cut(last), form, self.sentinels), first, last - first


def _in_portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut where the texts of `column` add up to about OUT_CHARS bytes."""
    for batch in batches:
        start, held = 0, 0
        for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            held += size or 0
            if held >= OUT_CHARS:
                yield batch.slice(start, k + 1 - start)
                start, held = k + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


MADE = [
    ("n", T.LongType()),
    ("form", T.StringType()),
    ("prefix_chars", T.LongType()),
    ("middle_chars", T.LongType()),
    ("output", T.StringType()),
    ("output_sha256", T.StringType()),
]


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and output_sha256 of every row.

    The text is cut at two drawn code points into prefix, middle and suffix. Form psm puts the suffix before
    the middle, spm before the prefix, each part behind its sentinel; plain leaves the text alone: a share of
    all, empty texts, and those that hold a sentinel. A null text counts as an empty one, a null doc_id draws
    as an empty one does. Any part may be empty. Repeated rows stay, with equal results; a very long text
    is handled whole by its row. Only doc_id and text are read, columns of other names are left out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, k) for n, k in MADE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_portions(batches, "text"):
            out: dict[str, list] = {name: [] for name, _ in MADE}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                form, table, prefix, middle = plan.table(doc_id, text)
                values = len(text), form, prefix, middle, table.text(), table.sha256()
                for (name, _), value in zip(MADE, values):
                    out[name].append(value)
            kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
            made = [pa.array(out[name], kinds[kind]) for name, kind in MADE]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *out])

    return rows.mapInArrow(run, schema)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """`made` with restored and restored_sha256: the text rebuilt from output and form alone.

    Columns of these two names are replaced. A null form is read as plain, a null output as an empty text.
    An output that is not of its form has nulls.
    """
    kept = [c for c in made.columns if c not in ("restored", "restored_sha256")]
    rows = made.select(*[F.col(f"`{c}`") for c in kept])
    added = [T.StructField(name, T.StringType()) for name in ("restored", "restored_sha256")]
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_portions(batches, "output"):
            texts, digests = [], []
            for form, output in zip(batch.column("form").to_pylist(), batch.column("output")):
                output = output.as_py() or ""
                plain = form is None or form == "plain"
                table = PieceTable(output, "") if plain else dissected(output, form, sentinels)
                texts.append(None if table is None else table.text())
                digests.append(None if table is None else table.sha256())
            more = [pa.array(texts, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, "restored", "restored_sha256"])

    return rows.mapInArrow(run, schema)


def middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row."""
    back = restore(fill_in_middle(docs).select("doc_id", *[n for n, _ in MADE]))
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )
