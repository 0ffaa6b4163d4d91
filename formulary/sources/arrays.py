"""JSON arrays read in parallel: one file of any size is cut into byte ranges, each read by a task of its own.

Where a range begins it is not known whether it begins inside a string. So two passes: the first counts
quotes and brackets of every range, for both cases at once; sums over the ranges before it then say how each range begins.
The second pass reads the elements that begin in a range, and beyond its end as far as the last of them
goes. Only a few numbers per range are ordered and joined; no text is shuffled. The elements leave the tasks as
text, which Spark parses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from formulary.sources.ranges import file_system

RANGE_BYTES = 32 << 20
STEP = 1 << 20  # bytes looked at beyond a range at once
QUOTE, BACKSLASH, OPEN, CLOSE, COMMA = ord('"'), ord("\\"), b"[{", b"]}", ord(",")
SPACES = b" \t\r\n"
STORES = {"file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss"}  # that tasks reach through Arrow


def byte_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """path, start, stop of every range of every file under `path`; the files are listed, not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {int(range_bytes)}L)")).alias("start")
    return files.select("path", "length", starts).select(
        "path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop")
    )


def _escaped_before(file: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands right before `start`."""
    n, at = 0, start
    while at > 0:
        size = min(at, 4096)
        file.seek(at - size)
        data = file.read(size)
        kept = len(data.rstrip(b"\\"))
        n += len(data) - kept
        if kept:
            break
        at -= size
    return n % 2 == 1


def real_quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Whether each byte is a quote that begins or ends a string. `escaped`: a backslash before the data escapes it."""
    slashes = data == BACKSLASH
    quotes = data == QUOTE
    if not slashes.any():
        if escaped and len(data):
            quotes[0] = False
        return quotes
    # Length of the run of backslashes right before each byte; the one before the data counts as one.
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slashes, -1, at))
    before = np.concatenate([[-1], last[:-1]])
    run = at - 1 - before
    run = run + np.where(before < 0, int(escaped), 0)
    return quotes & (run % 2 == 0)


def ends_escaped(data: np.ndarray, escaped: bool) -> bool:
    """Whether an odd number of backslashes ends the data; `escaped` says so of what stood before it."""
    other = np.flatnonzero(data != BACKSLASH)
    if len(other):
        return (len(data) - 1 - int(other[-1])) % 2 == 1
    return (len(data) + escaped) % 2 == 1


def counted(ranges: DataFrame) -> DataFrame:
    """`ranges` with quotes, and the brackets opened less those closed if the range begins `outside` or `inside` a string."""
    schema = "path string, start bigint, stop bigint, escaped boolean, quotes bigint, outside bigint, inside bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                store, path = file_system(row["path"])
                quotes, sums = 0, [0, 0]
                with store.open_input_file(path) as file:
                    row["escaped"] = escaped = _escaped_before(file, row["start"])
                    for at in range(row["start"], row["stop"], STEP):
                        file.seek(at)
                        data = np.frombuffer(file.read(min(STEP, row["stop"] - at)), np.uint8)
                        real = real_quotes(data, escaped)
                        escaped = ends_escaped(data, escaped)
                        odd = (np.cumsum(real) + quotes) % 2 == 1
                        steps = np.isin(data, list(OPEN)).astype(np.int8) - np.isin(data, list(CLOSE)).astype(np.int8)
                        for k, seen in enumerate((~odd, odd)):
                            sums[k] += int(steps[seen].sum(dtype=np.int64))
                        quotes += int(real.sum())
                out.append({**row, "quotes": quotes, "outside": sums[0], "inside": sums[1]})
            names = ["path", "start", "stop", "escaped", "quotes", "outside", "inside"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)

    return ranges.mapInArrow(run, schema)


def begun(counts: DataFrame) -> DataFrame:
    """path, start, stop, escaped, within (a string is open where the range begins), depth (brackets open there)."""
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    known = counts.withColumn("within", within)
    step = F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum(step).over(earlier), F.lit(0))
    return known.withColumn("depth", depth).select("path", "start", "stop", "escaped", "within", "depth")


class Elements:
    """The elements of an array that begin in one byte range: they begin behind its opening bracket or a comma."""

    def __init__(self, file, start: int, stop: int, escaped: bool, within: bool, depth: int):
        self.file, self.at, self.stop = file, start, stop
        self.escaped, self.within, self.depth = escaped, within, depth

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where elements of the array begin, where they end) in the next bytes; the state moves behind them."""
        real = real_quotes(data, self.escaped)
        within = (np.cumsum(real) + self.within) % 2 == 1
        steps = np.isin(data, list(OPEN)).astype(np.int64) - np.isin(data, list(CLOSE)).astype(np.int64)
        steps[within | real] = 0
        depth = self.depth + np.cumsum(steps)
        comma = (data == COMMA) & ~within & (depth == 1)
        opened = (steps == 1) & (depth == 1)
        closed = (steps == -1) & (depth == 0)
        self.escaped = ends_escaped(data, self.escaped)
        if len(data):
            self.within, self.depth = bool(within[-1]), int(depth[-1])
        return np.flatnonzero(comma | opened), np.flatnonzero(comma | closed)

    def __iter__(self) -> Iterator[bytes]:
        open_parts: list[bytes] | None = None  # of an element that has begun and not ended
        while True:
            inside = self.at < self.stop
            size = min(STEP, self.stop - self.at) if inside else STEP
            if not inside and open_parts is None:
                return
            self.file.seek(self.at)
            raw = self.file.read(size)
            if not raw:
                return
            self.at += len(raw)
            begins, ends = self._edges(np.frombuffer(raw, np.uint8))
            if not inside:
                begins = begins[:0]
            # In order: an end closes what is open, a beginning opens the next element; a comma does both.
            place = b = e = 0
            while True:
                if open_parts is not None:
                    while e < len(ends) and ends[e] < place:
                        e += 1
                    if e == len(ends):
                        open_parts.append(raw[place:])
                        break
                    yield b"".join([*open_parts, raw[place : ends[e]]])
                    open_parts, place = None, int(ends[e])
                while b < len(begins) and begins[b] < place:
                    b += 1
                if b == len(begins):
                    break
                open_parts, place = [], int(begins[b]) + 1
                b += 1


def elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """(value): the text of every element of the JSON arrays in the files under `path`, each file one array.

    A list of folders, a pattern or a partitioned folder will do as for other readers. The text around an array
    is ignored, an empty array has no elements. The files are read twice. None where they lie in a store that only
    Spark reads, not Arrow.
    """
    ranges = byte_ranges(spark, path, range_bytes)
    store = F.substring_index("path", ":", 1)
    count, *stores = ranges.agg(F.count("*"), F.min(store), F.max(store)).first()
    if not set(stores) - {None} <= STORES:
        return None
    # One task per range, up to a number that Spark schedules easily.
    tasks = max(1, min(count, 10_000))
    states = begun(counted(ranges.repartition(tasks, "path", "start"))).repartition(tasks, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row.pop("path"))
                with store.open_input_file(path) as file:
                    held, size = [], 0
                    for value in Elements(file, **row):
                        value = value.strip(SPACES)
                        if not value:
                            continue
                        held.append(value.decode("utf-8", "replace"))
                        size += len(value)
                        if size >= STEP:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    return states.mapInArrow(run, "value string")


def array_rows(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements as rows of `schema`; an element that is no object gives a row of nulls.

    Where only Spark reads the store, a file is one task.
    """
    parts = elements(spark, path, range_bytes)
    if parts is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return parts.select(F.from_json("value", schema).alias("row")).select("row.*")
