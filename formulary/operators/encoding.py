"""Vocabulary tables, text to ids and back, padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from formulary.functions import text as X
from formulary.operators.sampling import dense_index
from formulary.operators.skew import HEAVY_ROWS, lookup_join
from formulary.session import store

PAD, UNKNOWN, FIRST_ID = 0, 1, 2
# Beyond these the vocabulary is joined, not sent to every task.
MAX_SHIPPED_VOCAB = 500_000
MAX_SHIPPED_BYTES = 64 << 20
MAX_EXTENSION = 10_000
PORTION_TOKENS = 1 << 20  # tokens, or one longer row, whose different ones are joined as one portion


def _text(column: str) -> Column:
    return F.make_valid_utf8(F.col(column))  # bytes that are no text would stop Arrow's splitting


def _split(texts: pa.Array) -> pa.ListArray:
    """The tokens that functions.text.words gives, for a batch at once; an empty list for blank or missing text."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    tokens = lists.flatten()
    filled = pc.not_equal(tokens, "")  # blank text has one empty token
    counts = np.bincount(pc.list_parent_indices(lists).filter(filled).to_numpy(), minlength=len(lists))
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, tokens.filter(filled))


def vocab_build(df: DataFrame, size: int | None = None, text: str = "text") -> DataFrame:
    """(token, id) of the `size` most frequent tokens, or of all; ties by token. Ids follow the rank.

    Without a size the tokens are numbered by a distributed sort, which runs jobs when this is called.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _split(batch.column("text")).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "n"])

    # Repeats within an Arrow batch are counted there; only different tokens become rows.
    counts = df.select(_text(text).alias("text")).mapInArrow(counted, "token string, n bigint")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n"))
    if size is None:
        ranked = dense_index(counts.select("token", F.struct(-F.col("n"), "token").alias("rank")), "rank")
        return ranked.select("token", (F.col("idx") + FIRST_ID).cast("int").alias("id"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    # The limit leaves at most `size` rows for this unpartitioned window.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select("token", (rank + (FIRST_ID - 1)).cast("int").alias("id"))


def extend_vocab(vocab: DataFrame, tokens: list[str]) -> DataFrame:
    """Add the missing ones of a short token list with ids above the current maximum; others stay.

    The list is the caller's own, goes to every task and may hold at most MAX_EXTENSION tokens.
    """
    if len(tokens) > MAX_EXTENSION:
        raise ValueError(f"{len(tokens)} tokens; join a table of them instead")
    spark = vocab.sparkSession
    new = spark.createDataFrame(list(enumerate(dict.fromkeys(tokens))), "pos int, token string")
    known = vocab.join(F.broadcast(new), "token", "left_semi").select("token")
    top = vocab.agg(F.coalesce(F.max("id"), F.lit(FIRST_ID - 1))).scalar()
    missing = new.join(known, "token", "left_anti")
    rank = F.row_number().over(Window.orderBy("pos"))
    return vocab.select("token", "id").union(missing.select("token", (top + rank).cast("int").alias("id")))


class Index:
    """A lookup table for tasks. Its hash table is built once in a Python worker, whatever batches and tasks it has."""

    def __init__(self, keys: pa.Array, values: pa.Array):
        self.keys, self.values = keys, values
        self._place: dict | None = None

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.__init__(*state)

    def of(self, keys: pa.Array) -> pa.Array:
        """Their values, null where there is none. Every different key is looked up once."""
        if self._place is None:
            self._place = {k: i for i, k in enumerate(self.keys.to_pylist())}
        coded = keys.dictionary_encode()
        found = pa.array(map(self._place.get, coded.dictionary.to_pylist()), pa.int64())
        return self.values.take(found).take(coded.indices)


def _small_vocab(vocab: DataFrame, limit: int, key: str, value: str) -> Index | None:
    """The vocabulary as an index if its checked size allows sending it to every task."""
    entries, size = vocab.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    if entries > limit or size > MAX_SHIPPED_BYTES:
        return None
    table = vocab.select("token", "id").toArrow().combine_chunks()
    return Index(*(_one(table[c]) for c in (key, value)))


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _offsets(lists: pa.ListArray) -> pa.Array:
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])


def _with_elements(lists: pa.ListArray, elements: pa.Array) -> pa.ListArray:
    """Other elements in lists of the same lengths."""
    return pa.ListArray.from_arrays(_offsets(lists), elements, mask=lists.is_null())


def _joined_text(tokens: pa.ListArray) -> pa.Array:
    """Tokens that are not null, with blanks between them."""
    flat = tokens.flatten()
    owner = pc.list_parent_indices(tokens).filter(flat.is_valid())
    counts = np.bincount(owner.to_numpy(), minlength=len(tokens)).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, flat.drop_null()), " ")


def encode(
    df: DataFrame,
    vocab: DataFrame,
    text: str | dict[str, str] = "text",
    max_shipped: int = MAX_SHIPPED_VOCAB,
) -> DataFrame:
    """(row_id, ids): whitespace tokens of the whole text as ids, unknown ones as UNKNOWN.

    Several texts of a row are encoded in one pass when given as {result column: text column}.

    A vocabulary of checked size is shipped to the tasks and looked up there. A larger one is joined with
    the different tokens of each portion of rows; frequent tokens are then served by broadcast. Both give the
    same rows. Jobs run when this is called: the vocabulary is measured, and for a join the portions are written
    and frequent tokens counted.
    """
    texts = {"ids": text} if isinstance(text, str) else text
    whole = df.select("row_id", *[_text(c).alias(out) for out, c in texts.items()])
    index = _small_vocab(vocab, max_shipped, "token", "id")
    if index is None:
        return _encode_by_join(whole, vocab)
    shipped = df.sparkSession.sparkContext.broadcast(index)
    outs = list(texts)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_split(batch.column(o)) for o in outs]
            mapped = [_with_elements(x, pc.fill_null(shipped.value.of(x.flatten()), UNKNOWN)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *mapped], ["row_id", *outs])

    kinds = "".join(f", {o} array<int>" for o in outs)
    return whole.mapInArrow(look_up, f"row_id {_type(df, 'row_id')}{kinds}")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _portions(batch: pa.RecordBatch, outs: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch cut where its lists hold about PORTION_TOKENS elements."""
    sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(o)), 0)).astype(np.int64) for o in outs)
    portion = np.cumsum(sizes) // PORTION_TOKENS
    starts = np.flatnonzero(np.append(True, portion[1:] != portion[:-1])) if len(portion) else []
    for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(start), int(stop - start))


def _exchanged(
    rows: DataFrame,
    lookup: DataFrame,
    payload: str,
    min_heavy_rows: int,
    finish: Callable[[pa.ListArray], pa.Array],
    kind: str,
) -> DataFrame:
    """row_id and the lists of `rows`, or the tokens of its texts, each element replaced by its payload in `lookup`
    (token, payload).

    No element becomes a row. A task numbers the different elements of a portion of rows; the lists keep these
    numbers, and each different element leaves once, to be joined. What it found comes back to its portion, of
    bounded size. The portions are written down, so a lost executor changes no number.
    """
    outs = [c for c in rows.columns if c != "row_id"]
    row_id = _type(rows, "row_id")
    numbers = "".join(f", {o} array<int>" for o in outs)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [c if pa.types.is_list(c.type) else _split(c) for c in map(batch.column, outs)]
        return pa.RecordBatch.from_arrays([batch.column("row_id"), *lists], ["row_id", *outs])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = TaskContext.get().partitionId() << 32
        names = ["portion", "place", "token", "row_id", *outs]
        for batch in (part for whole in batches for part in _portions(cut(whole), outs)):
            lists = [batch.column(o) for o in outs]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            codes, at, numbered = coded.indices.cast(pa.int32()), 0, []
            for x in lists:
                size = len(x.flatten())
                numbered.append(_with_elements(x, codes.slice(at, size)))
                at += size
            n, m = batch.num_rows, len(coded.dictionary)
            key = pa.array(np.full(max(n, m), portion))
            none = pa.nulls(n, pa.string())
            kept = [key.slice(0, n), pa.array(np.full(n, -1, np.int32)), none, batch.column("row_id"), *numbered]
            yield pa.RecordBatch.from_arrays(kept, names)
            own = [key.slice(0, m), pa.array(np.arange(m, dtype=np.int32)), coded.dictionary.cast(pa.string())]
            blank = [pa.nulls(m, x.type) for x in kept[3:]]
            yield pa.RecordBatch.from_arrays([*own, *blank], names)
            portion += 1

    schema = f"portion bigint, place int, token string, row_id {row_id}{numbers}"
    parts = store(rows.mapInArrow(apart, schema), "portions")
    asked = parts.filter("place >= 0").select("portion", "place", "token")
    if parts.filter("place = 0").count() < min_heavy_rows:
        # A portion asks for an element once, so none is frequent and nothing has to be counted.
        found = asked.join(lookup.select("token", payload), "token", "left")
    else:
        found = lookup_join(asked, lookup, "token", payload, ["portion", "place"], min_heavy_rows)

    def together(lists: pa.Table, values: pa.Table) -> pa.Table:
        order = pc.sort_indices(values["place"])
        known = _one(values[payload].take(order))
        columns = [_one(lists["row_id"])]
        for o in outs:
            own = _one(lists[o])
            columns.append(finish(_with_elements(own, known.take(own.flatten()))))
        return pa.Table.from_arrays(columns, ["row_id", *outs])

    kept = parts.filter("place < 0").select("portion", "row_id", *outs).groupBy("portion")
    back = kept.cogroup(found.select(F.col("portion").alias("of"), "place", payload).groupBy("of"))
    return back.applyInArrow(together, f"row_id {row_id}" + "".join(f", {o} {kind}" for o in outs))


def _encode_by_join(tokens: DataFrame, vocab: DataFrame, min_heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`tokens` holds texts or lists of tokens."""

    def known_or_not(ids: pa.ListArray) -> pa.Array:
        return _with_elements(ids, pc.fill_null(ids.flatten(), UNKNOWN))

    lookup = vocab.select("token", "id").filter("token IS NOT NULL")
    return _exchanged(tokens, lookup, "id", min_heavy_rows, known_or_not, "array<int>")


def training_rows(prompts: DataFrame, vocab: DataFrame, length: int = 512) -> DataFrame:
    """(row_id, input_ids, attention_mask, labels) from (row_id, nl, label), all `length` long."""
    encoded = encode(prompts, vocab, {"ids": "nl", "target": "label"})
    return encoded.select(
        "row_id",
        X.pad_truncate("ids", length, PAD).alias("input_ids"),
        X.attention_mask("ids", length).alias("attention_mask"),
        X.pad_truncate("target", length, PAD).alias("labels"),
    )


def fixed_length(encoded: DataFrame, length: int, pad: int = PAD) -> DataFrame:
    """(row_id, input_ids, attention_mask), both exactly `length` long."""
    return encoded.select(
        "row_id",
        X.pad_truncate("ids", length, pad).alias("input_ids"),
        X.attention_mask("ids", length).alias("attention_mask"),
    )


def batch_pad(encoded: DataFrame, side: str = "left", pad: int = PAD) -> DataFrame:
    """Adds `padded` and `mask`: ids filled up to the longest row of their batch."""
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    missing = longest - F.size("ids")
    fill, none = F.array_repeat(F.lit(pad).cast("int"), missing), F.array_repeat(F.lit(0), missing)
    ones = F.array_repeat(F.lit(1), F.size("ids"))  # in generated code, which a function over the array is not
    left = side == "left"
    return encoded.select(
        *[F.col(f"`{c}`") for c in encoded.columns if c not in ("padded", "mask")],
        (F.concat(fill, "ids") if left else F.concat("ids", fill)).alias("padded"),
        (F.concat(none, ones) if left else F.concat(ones, none)).alias("mask"),
    )


def decode(
    encoded: DataFrame,
    vocab: DataFrame,
    specials: tuple[int, ...] = (PAD,),
    max_shipped: int = MAX_SHIPPED_VOCAB,
) -> DataFrame:
    """(row_id, text): ids as blank-joined tokens; special and unheard-of ids are skipped."""
    kept = encoded.select(
        "row_id", F.filter("ids", lambda i: ~i.isin(list(specials)) if specials else F.lit(True)).alias("ids")
    )
    index = _small_vocab(vocab, max_shipped, "id", "token")
    if index is None:
        return _decode_by_join(kept, vocab)
    shipped = encoded.sparkSession.sparkContext.broadcast(index)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            text = _joined_text(_with_elements(ids, shipped.value.of(ids.flatten())))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), text], ["row_id", "text"])

    return kept.mapInArrow(look_up, f"row_id {_type(encoded, 'row_id')}, text string")


def _decode_by_join(kept: DataFrame, vocab: DataFrame, min_heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    by_id = vocab.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("token"), F.col("token").alias("text"))
    rows = kept.select("row_id", F.col("ids").alias("text"))
    return _exchanged(rows, by_id, "text", min_heavy_rows, _joined_text, "string")
