"""Data sources that read parts of files: fixed-size trace records by byte ranges, and the last lines of logs.

Files are opened through Arrow's filesystems (local and shared folders, HDFS and object stores), by tasks
that seek to their own range: no file is read whole by one task.
"""

from __future__ import annotations

import glob
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tidewake.sources import wire

TRACE_SCHEMA = "path string, record long, version int, kind int, flags int, sensor_time_ns long, recv_mono_ns long, consume_mono_ns long, publish_mono_ns long, age_ms long, fault_code long"
_FORMATS = {"u8": "u1", "u16": "<u2", "u32": "<u4", "i64": "<i8"}
TRACE_TYPE = np.dtype({"names": [n for n, *_ in wire.TRACE_RECORD.fields], "formats": [_FORMATS[k] for _, k, *_ in wire.TRACE_RECORD.fields], "offsets": [o for *_, o in wire.TRACE_RECORD.fields], "itemsize": wire.TRACE_RECORD.size})


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of ``path`` and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def files_of(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of the files that ``path`` means, in order of names: a file, a folder, or (on local filesystems) a glob."""
    store, inside = opened(path)
    if isinstance(store, fs.LocalFileSystem) and glob.has_magic(inside):
        infos = [i for p in glob.glob(inside) for i in ([store.get_file_info(p)] if store.get_file_info(p).type == fs.FileType.File else store.get_file_info(fs.FileSelector(p, recursive=True)))]
    else:
        info = store.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    kept = [i for i in infos if i.type == fs.FileType.File and not posixpath.basename(i.path).startswith(("_", ".")) and i.path.endswith(suffix)]
    return sorted((scheme + i.path, i.size) for i in kept)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class TraceReader(DataSourceReader):
    """Ranges of ``range_bytes`` of each file, whole records each; an incomplete last record is left out. Filters on ``kind`` are applied before records leave the reader."""

    def __init__(self, options: dict) -> None:
        self.path, self.kinds = options["path"], None
        size = wire.TRACE_RECORD.size
        self.step = max(size, int(options.get("range_bytes", 64 << 20)) // size * size)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {int(f.value)} if self.kinds is None else self.kinds & {int(f.value)}
            elif isinstance(f, In) and f.attribute == ("kind",):
                mine = {int(v) for v in f.value if v is not None}
                self.kinds = mine if self.kinds is None else self.kinds & mine
            else:
                yield f  # left to Spark

    def partitions(self) -> Sequence[Range]:
        size = wire.TRACE_RECORD.size
        out = []
        for path, length in files_of(self.path):
            whole = length // size * size
            out += [Range(path, at, min(at + self.step, whole)) for at in range(0, whole, self.step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Range):
            return  # there are no files, or none with a record
        store, inside = opened(part.path)
        with store.open_input_file(inside) as f:
            f.seek(part.start)
            at, left = part.start // TRACE_TYPE.itemsize, part.end - part.start
            while left > 0:
                data = f.read(min(left, 8 << 20) // TRACE_TYPE.itemsize * TRACE_TYPE.itemsize)
                rows = np.frombuffer(data, TRACE_TYPE)
                number = at + np.arange(len(rows))
                at, left = at + len(rows), left - len(data)
                if self.kinds is not None:
                    keep = np.isin(rows["kind"], sorted(self.kinds))
                    rows, number = rows[keep], number[keep]
                names = [n for n, *_ in wire.TRACE_RECORD.fields if not n.startswith("reserved")]
                columns = [pa.array(rows[n].astype(np.int32 if n in ("version", "kind", "flags") else np.int64)) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows), pa.string()), pa.array(number.astype(np.int64)), *columns], names=["path", "record", *names])


@dataclass
class Written(WriterCommitMessage):
    name: str


class TraceWriter(DataSourceArrowWriter):
    """A file of records for each task, under its final name once all tasks have ended."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, inside = opened(self.path)
        store.create_dir(inside, recursive=True)
        name = f"trace-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{inside}/_{name}") as f:
            for batch in batches:
                rows = np.zeros(batch.num_rows, TRACE_TYPE)
                for n in rows.dtype.names:
                    if n in batch.schema.names:
                        rows[n] = batch.column(n).to_numpy(zero_copy_only=False)
                f.write(rows.tobytes())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, inside = opened(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{inside}/_{m.name}", f"{inside}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, inside = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{inside}/_{m.name}")


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewake_trace"

    def schema(self) -> str:
        return TRACE_SCHEMA

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options)

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options)


def binary_trace(spark: SparkSession, path: str, *, range_bytes: int = 64 << 20) -> DataFrame:
    """TRACE_SCHEMA: the timing records of the files under ``path``, ``record`` counted from 0 in each file.

    A file is read in ranges of about ``range_bytes`` by as many tasks; filters on ``kind`` reach the reader.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)
    return spark.read.format("tidewake_trace").option("path", path).option("range_bytes", str(range_bytes)).load()


def write_trace(df: DataFrame, path: str) -> None:
    """Rows with the fields of a trace record (lacking ones are 0) as binary files under ``path``."""
    df.sparkSession.dataSource.register(TraceSource)
    df.write.format("tidewake_trace").option("path", path).mode("append").save()


@dataclass
class Ranges(InputPartition):
    parts: list[Range]


#: Ends of files that one task reads, one after the other, at most, and the tasks that there are before any reads more than one.
ENDS_A_TASK, LEAST_TASKS = 512, 64


class TailReader(DataSourceReader):
    """The last lines of each file, from at most its last ``most_bytes`` bytes; with ``header`` its first line, too. A task takes many files where there are many."""

    def __init__(self, options: dict) -> None:
        self.path, self.lines, self.most, self.header = options["path"], int(options["lines"]), int(options["most_bytes"]), options["header"] == "true"

    def partitions(self) -> Sequence[Range]:
        ends = [Range(path, max(0, size - self.most), size) for path, size in files_of(self.path)]
        each = max(1, min(ENDS_A_TASK, len(ends) // LEAST_TASKS))
        return [Ranges(ends[i : i + each]) for i in range(0, len(ends), each)]

    def read(self, parts: Ranges | None) -> Iterator[tuple]:
        if isinstance(parts, Ranges):
            for part in parts.parts:
                yield from self.ends(part)

    def ends(self, part: Range) -> Iterator[tuple]:
        store, inside = opened(part.path)
        with store.open_input_file(inside) as f:
            head = f.read(min(part.end, self.most)).split(b"\n", 1)[0] if self.header else b""
            f.seek(part.start)
            rows = [(part.start, b"")]
            for line in f.read(part.end - part.start).split(b"\n"):
                rows.append((rows[-1][0] + len(rows[-1][1]) + (len(rows) > 1), line))
        rows = rows[1:]
        if self.header:
            rows = [r for r in rows if r[0] > 0]  # the first line isn't a row
        rows = [line for _, line in rows if line.strip(b"\r")]
        text = lambda x: x.strip(b"\r").decode("utf-8", "ignore")
        for i, line in enumerate(rows[-self.lines :]):
            yield part.path, i, text(line), text(head) if self.header else None, part.end - part.start


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewake_tail"

    def schema(self) -> str:
        return "path string, line int, value string, header string, bytes_read long"

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)


def tails(spark: SparkSession, path: str, lines: int = 40, most_bytes: int = 32 << 10, *, header: bool = False) -> DataFrame:
    """(path, line, value, header, bytes_read): the last ``lines`` lines of each file under ``path`` that aren't empty.

    Only the last ``most_bytes`` bytes of a file are read (and as many of its beginning for ``header``), so the first of its lines may be cut; bytes
    that aren't UTF-8 are left out.
    """
    spark.dataSource.register(TailSource)
    options = {"path": path, "lines": str(lines), "most_bytes": str(most_bytes), "header": str(header).lower()}
    return spark.read.format("tidewake_tail").options(**options).load()
