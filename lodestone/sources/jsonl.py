"""JSON Lines as a data source: lines with their places, and appends that count once.

The reader cuts files into ranges of bytes; a line belongs to the range in which it begins. So every line has
a file and an offset, and "the last line of a key" needs no column that counts. The writer's tasks write
parts of their own; a commit lists them under the name of its writer and batch, and readers of committed
lines see listed parts alone. A batch that is run again, or a task that is tried again, adds nothing.

Paths are those of ``pyarrow.fs`` (plain or file:, hdfs:, s3:, gs:), seen by the driver and all executors.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from .tables import ship_code

FORMAT = "lodestone_jsonl"
COMMITS = "_commits"
_BUFFER = 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str, committed: bool) -> list[fs.FileInfo]:
    """The files to read, in the order of their names or of their commits' names."""
    system, root = file_system(path)
    if system.get_file_info(root).is_file:
        return [system.get_file_info(root)]
    if not committed:
        found = system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
        return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
    marks = system.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    names: list[str] = []
    for mark in sorted((m for m in marks if m.extension == "json"), key=lambda m: m.base_name):
        with system.open_input_file(mark.path) as f:
            names += json.loads(f.read())["parts"]
    return system.get_file_info([f"{root}/{n}" for n in names]) if names else []


def range_bytes(spark: SparkSession, path: str, least: int, most: int = 64 << 20) -> int:
    """Bytes of a range for four tasks a core, within bounds: the number of tasks doesn't grow with the lines
    until ranges are as long as ``most``."""
    total = sum(f.size for f in _files(path, committed=False))
    return min(most, max(least, -(-total // (4 * spark.sparkContext.defaultParallelism))))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def lines_from(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in ``start`` to ``end`` (exclusive), without their ends."""
    at, rest = start, b""
    file.seek(max(0, start - 1))
    skipping = start > 0  # up to the end of a line that began before
    if skipping:
        at = start - 1
    while True:
        block = file.read(_BUFFER)
        if not block:
            break
        rest += block
        *lines, rest = rest.split(b"\n")
        for line in lines:
            if skipping:
                skipping = False
            elif at < end:
                yield at, line
            at += len(line) + 1
            if at >= end:
                return
    if rest and not skipping and at < end:
        yield at, rest


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.committed = options.get("committed", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        found = [(f.path, f.size) for f in _files(self.path, self.committed)]
        return [Range(path, start, min(start + self.range_bytes, size)) for path, size in found for start in range(0, size, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only partition where there is nothing to read
            return
        system, _ = file_system(self.path)
        offsets: list[int] = []
        lines: list[str] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())], names=["file", "offset", "line"])

        held = 0
        with system.open_input_file(partition.path) as file:
            for offset, line in lines_from(file, partition.start, partition.end):
                offsets.append(offset)
                lines.append(line.decode("utf-8", "replace"))
                held += len(line)
                if len(lines) >= 10_000 or held >= 4 << 20:
                    yield batch()
                    offsets, lines, held = [], [], 0
        if lines:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    part: str | None


class _Parts:
    """Parts of a task, and the commit that lists them."""

    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options.get("writer", "writer")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.jsonl"
        first = next(iterator, None)
        if first is None:
            return Written(None)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            for row in itertools.chain([first], iterator):
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
        return Written(name)

    def publish(self, messages: list[Written | None], batch: str) -> None:
        """List the parts, unless the batch is listed already; parts that don't count are deleted."""
        system, root = file_system(self.path)
        parts = sorted(m.part for m in messages if m is not None and m.part)
        mark = f"{root}/{COMMITS}/{self.writer}-{batch}.json"
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        if system.get_file_info(mark).is_file:
            self.discard(messages)
            return
        draft = f"{root}/{COMMITS}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"parts": parts}).encode())
        system.move(draft, mark)

    def discard(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None and m.part and system.get_file_info(f"{root}/{m.part}").is_file:
                system.delete_file(f"{root}/{m.part}")


class LineWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.parts, self.run = _Parts(options), options.get("run") or uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.parts.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.parts.publish(messages, self.run)

    def abort(self, messages: list[Written | None]) -> None:
        self.parts.discard(messages)


class LineStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.parts = _Parts(options)

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.parts.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803  Spark's own name
        self.parts.publish(messages, f"{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.parts.discard(messages)


class JsonLines(DataSource):
    """``path``; for reading ``rangeBytes`` and ``committed``, for writing ``writer`` and (batches) ``run``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def writer(self, schema, overwrite: bool) -> LineWriter:
        if overwrite:
            raise ValueError("lines are only appended")
        return LineWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> LineStreamWriter:  # noqa: N802  Spark's own name
        return LineStreamWriter(self.options)


def _ready(spark: SparkSession) -> None:
    ship_code(spark)
    spark.dataSource.register(JsonLines)


def read_lines(spark: SparkSession, path: str, committed: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """file, offset and line of every line; with ``committed`` only lines that a commit lists."""
    _ready(spark)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).option("committed", str(committed).lower()).load(path)


def read_records(spark: SparkSession, path: str, schema: str, committed: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """The lines' objects with their file and offset; lines that are no whole object are left out."""
    rows = read_lines(spark, path, committed, range_bytes)
    whole = F.from_json("line", f"{schema}, _cut string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_cut"})
    found = rows.withColumn("x", whole).where("x is not null and x._cut is null and ltrim(line) like '{%'")
    return found.select("file", "offset", "x.*").drop("_cut")


def last_records(spark: SparkSession, path: str, schema: str, key: str, committed: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """Of every key's records the one whose line stands last: in the last file, and there at the last place."""
    rows = read_records(spark, path, schema, committed, range_bytes).where(F.col(key).isNotNull())
    columns = [c for c in rows.columns if c not in ("file", "offset")]
    place = F.struct("file", "offset")
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), place).alias("x")).select("x.*")


def append(rows: DataFrame, path: str, run: str, writer: str = "run") -> None:
    """Append the rows as lines, once for each ``run``, however often it is tried."""
    _ready(rows.sparkSession)
    rows.write.format(FORMAT).option("writer", writer).option("run", run).mode("append").save(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, writer: str) -> StreamingQuery:
    """Append each batch of a stream once. Streams that append to one path need names of their own."""
    _ready(rows.sparkSession)
    return rows.writeStream.format(FORMAT).option("writer", writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
