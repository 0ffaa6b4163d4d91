"""Runs that go on where they broke: rows in numbered ranges, and a sink whose tasks commit finished ranges.

`plan_ranges` writes the rows of a run down once, cut into ranges; that fixes which range a row belongs to,
also where rows share an id or have none. The sink writes the answers of a range to a file of its own and renames it
into place when the last row is there, so a file that can be seen is a commit: whatever a killed run has
committed is kept, and `open_ranges` leaves only the rest for the next one. A task that Spark runs
again skips what its earlier attempt has committed (`skip_committed`). Driver and tasks reach the files
through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from formulary.session import path_exists, touch

RANGE, PLACE = "_range", "_place"  # columns of a planned row
REQUESTS, ANSWERS, ATTEMPTS, PLANNED = "requests", "answers", "_attempts", "_PLANNED"
FLUSH_BYTES = 8 << 20  # answers of a range held before they go to its file, however large the range is
POSITIONS = 33  # bits of a row's position in its partition


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI or absolute path, and the path within it."""
    if "://" not in path and not path.startswith("/"):
        path = re.sub(r"^(\w+):/(?!/)", r"\1:///", path)
    path = re.sub(r"^s3[an]://", "s3://", path)  # Hadoop's names for it
    return fs.FileSystem.from_uri(path)


def range_file(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{ANSWERS}/range-{number}.parquet"


def plan_ranges(spark: SparkSession, rows: DataFrame, root: str, range_rows: int) -> None:
    """Writes `rows` with RANGE and PLACE under `root`: ranges of up to `range_rows` rows that lie together.

    Nothing is sorted or shuffled. A plan that was not finished is written again.
    """
    if range_rows < 1:
        raise ValueError("a range holds at least one row")
    at = F.monotonically_increasing_id()
    inside = at.bitwiseAND(F.lit((1 << POSITIONS) - 1))
    number = F.shiftleft(F.shiftright(at, POSITIONS), POSITIONS) + F.floor(inside / range_rows)
    placed = rows.withColumns({RANGE: number, PLACE: inside % range_rows})
    placed.write.mode("overwrite").parquet(f"{root}/{REQUESTS}")
    touch(spark, f"{root}/{PLANNED}")


def planned(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the run under `root`, None where its plan was never finished."""
    if not path_exists(spark, f"{root}/{PLANNED}"):
        return None
    return spark.read.parquet(f"{root}/{REQUESTS}")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(RANGE) of every committed range, from the names of the files alone."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{ANSWERS}/range-*.parquet").select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{RANGE} bigint")
    return files.select(F.regexp_extract("path", r"range-(\d+)\.parquet$", 1).cast("bigint").alias(RANGE))


def open_ranges(spark: SparkSession, root: str, first: int | None = None) -> tuple[DataFrame, int]:
    """(the planned rows of ranges that nobody has committed, how many ranges those are); `first` bounds the number."""
    rows = planned(spark, root)
    numbers = rows.select(RANGE).distinct().join(committed(spark, root), RANGE, "left_anti")
    if first is not None:
        numbers = numbers.orderBy(RANGE).limit(first)
    # Ranges are numbered once, so this is read once and for all; it holds one number per range.
    count = numbers.count()
    return rows.join(numbers, RANGE, "left_semi"), count


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Whole ranges, rows in order, over `tasks` tasks."""
    return rows.repartition(max(1, tasks), RANGE).sortWithinPartitions(RANGE, PLACE)


def skip_committed(rows: DataFrame, root: str) -> DataFrame:
    """`rows`, dealt out by range, without ranges that are committed by the time the task comes to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(root)
        known: dict[int, bool] = {}
        for batch in batches:
            numbers = batch.column(RANGE).to_pylist()
            for number in set(numbers) - known.keys():
                _, path = file_system(range_file(root, number))
                known[number] = store.get_file_info(path).type == fs.FileType.NotFound
            yield batch.filter(pa.array([known[n] for n in numbers], pa.bool_()))
            known = {numbers[-1]: known[numbers[-1]]} if numbers else known

    return rows.mapInArrow(run, rows.schema)


@dataclass
class Committed(WriterCommitMessage):
    ranges: int
    rows: int


class _RangeFile:
    """Answers of one range, in a file of this attempt until `close` renames it."""

    def __init__(self, root: str, run: str, number: int):
        self.store, self.path = file_system(range_file(root, number))
        _, attempts = file_system(f"{root.rstrip('/')}/{ATTEMPTS}/{run}")
        self.store.create_dir(attempts)
        self.own = f"{attempts}/{uuid.uuid4().hex}.parquet"
        self.writer: pq.ParquetWriter | None = None
        self.held: list[pa.RecordBatch] = []
        self.bytes = self.rows = 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.bytes += rows.nbytes
        self.rows += rows.num_rows
        if self.bytes >= FLUSH_BYTES:
            self._flush()

    def _flush(self) -> None:
        table = pa.Table.from_batches(self.held)
        if self.writer is None:
            self.writer = pq.ParquetWriter(self.own, table.schema, filesystem=self.store)
        self.writer.write_table(table)
        self.held, self.bytes = [], 0
        del table
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest flush took

    def close(self) -> None:
        if self.held:
            self._flush()
        self.writer.close()
        self.store.create_dir(self.path.rsplit("/", 1)[0])
        if self.store.get_file_info(self.path).type == fs.FileType.NotFound:
            self.store.move(self.own, self.path)
        else:  # another attempt was faster; its answers stay
            self.store.delete_file(self.own)


class RangeWriter(DataSourceArrowWriter):
    """Rows of a range must follow one another; the range is committed when another one begins, or at the end."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        number, file, ranges, rows = None, None, 0, 0
        closed: set[int] = set()
        for batch in iterator:
            numbers = batch.column(RANGE).to_numpy()
            own = batch.drop_columns([RANGE])
            start = 0
            while start < len(numbers):
                differ = (numbers[start:] != numbers[start]).nonzero()[0]
                stop = start + int(differ[0]) if len(differ) else len(numbers)
                if numbers[start] != number:
                    if file is not None:
                        file.close()
                        closed.add(number)
                    number = int(numbers[start])
                    if number in closed:
                        raise ValueError(f"rows of range {number} do not follow one another")
                    file, ranges = _RangeFile(self.root, self.run, number), ranges + 1
                file.add(own.slice(start, stop - start))
                rows += stop - start
                start = stop
        if file is not None:
            file.close()
        return Committed(ranges, rows)

    def _tidy(self) -> None:
        store, path = file_system(f"{self.root.rstrip('/')}/{ATTEMPTS}/{self.run}")
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)

    def commit(self, messages: list) -> None:
        self._tidy()

    def abort(self, messages: list) -> None:
        self._tidy()


class RangeSink(DataSource):
    """df.write.format("ranges").mode("append").save(root): rows with RANGE, committed range by range."""

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def writer(self, schema: T.StructType, overwrite: bool) -> RangeWriter:
        if RANGE not in schema.names:
            raise ValueError(f"rows need the column {RANGE}")
        return RangeWriter(self.options["path"], uuid.uuid4().hex)


def write_ranges(rows: DataFrame, root: str) -> None:
    """Commits the ranges of `rows`, in which each one lies in one task and in one piece, under `root`."""
    rows.sparkSession.dataSource.register(RangeSink)
    rows.write.format(RangeSink.name()).mode("append").save(root)


def answers(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """What has been committed under `root`."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{ANSWERS}/range-*.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
