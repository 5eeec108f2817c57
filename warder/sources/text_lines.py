"""Lines of text files with their byte offsets, as a data source: in batch, cut into byte ranges,
and as a stream that follows growing files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "log_lines"
SCHEMA = "file string, offset long, value string"
#: Bytes of a file that one task reads, and that are held at once.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Tasks from which adjacent small ranges share one, up to RANGE_BYTES of text, and are read one by one.
TASKS = 200


class ByteRange(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def log_files(paths: list[str]) -> dict[str, int]:
    """Sizes of the files that the paths name: files, or folders with all below; hidden ones not."""
    found = {}
    for path in paths:
        system, at = opened(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        head = path[: len(path) - len(at)] if path.endswith(at) else ""
        for i in infos:
            below = i.path[len(at) :]
            if i.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in (below or i.base_name).split("/")):
                found[head + i.path] = i.size
    return dict(sorted(found.items()))


def lines(file: str, start: int, end: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end), without their ends. The last one
    may go on beyond; one that began before belongs to the range before."""
    system, at = opened(file)
    with system.open_input_file(at) as f:
        at = max(start - 1, 0)
        f.seek(at)
        held, skip = b"", start > 0  # up to the line's end at start - 1 or later
        while True:
            data = f.read(chunk)
            if not data:
                break
            held += data
            first = 0
            while (nl := held.find(b"\n", first)) >= 0:
                here = at + first
                if not skip:
                    if here >= end:
                        return
                    yield here, held[first:nl].removesuffix(b"\r")
                skip, first = False, nl + 1
            held, at = held[first:], at + first
            if at >= end and not skip:
                return
        if held and not skip and at < end:
            yield at, held.removesuffix(b"\r")


def last_line_end(file: str, start: int, size: int, chunk: int = CHUNK_BYTES) -> int:
    """Where the last whole line of [start, size) ends; ``start`` if there is none."""
    system, path = opened(file)
    with system.open_input_file(path) as f:
        end = size
        while end > start:
            at = max(start, end - chunk)
            f.seek(at)
            nl = f.read(end - at).rfind(b"\n")
            if nl >= 0:
                return at + nl + 1
            end = at
    return start


def batches(part: ByteRange) -> Iterator[pa.RecordBatch]:
    offsets, values, held = [], [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array([part.file] * len(values), pa.string()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=["file", "offset", "value"])
    for offset, line in lines(part.file, part.start, part.end):
        offsets.append(offset)
        values.append(line.decode("utf-8", "replace"))
        held += len(line)
        if held >= CHUNK_BYTES or len(values) >= 10_000:
            yield make()
            offsets, values, held = [], [], 0
    yield make()


def cut(file: str, start: int, end: int, size: int) -> list[ByteRange]:
    return [ByteRange(file, at, min(at + size, end)) for at in range(start, end, size)]


def tasks(files: dict[str, tuple[int, int]], size: int) -> list[ByteRange]:
    """What each task reads of files, given by their (start, end): ranges of ``size`` bytes, several
    adjacent ones where there are many."""
    ranges = sum(-(-(end - start) // size) for start, end in files.values())
    span = size * max(1, min(-(-ranges // TASKS), RANGE_BYTES // size))
    return [r for file, (start, end) in files.items() for r in cut(file, start, end, span)]


def task_batches(part: ByteRange, size: int) -> Iterator[pa.RecordBatch]:
    for r in cut(part.file, part.start, part.end, size):
        yield from batches(r)


class LineReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[ByteRange]:
        return tasks({file: (0, n) for file, n in log_files(self.paths).items()}, self.size) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return task_batches(partition, self.size) if partition.file else iter(())


class LineStreamReader(DataSourceStreamReader):
    """Follows files: an offset is how far each has been read, always at the end of a line, so a
    line that is still being written waits. A file that has become shorter is read anew."""

    def __init__(self, paths: list[str], size: int):
        self.paths, self.size, self.seen = paths, size, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, n in log_files(self.paths).items():
            before = self.seen.get(file, 0)
            self.seen[file] = last_line_end(file, before if before <= n else 0, n)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        from_ = {file: start.get(file, 0) if start.get(file, 0) <= to else 0 for file, to in end.items()}
        return tasks({file: (from_[file], to) for file, to in end.items()}, self.size)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return task_batches(partition, self.size)

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    """Format ``log_lines``: (file, offset, value). Options: ``path``, or ``paths`` with one path a
    line; ``rangeBytes``, what is read of a file at once."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _paths(self) -> list[str]:
        found = [p for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p]
        if not found:
            raise ValueError("log_lines needs the option path or paths")
        return found

    def _size(self) -> int:
        return int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema) -> LineReader:
        return LineReader(self._paths(), self._size())

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self._paths(), self._size())


def read_lines(spark: SparkSession, path: str | list[str], stream: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, offset, value) of every line of text files or folders."""
    spark.dataSource.register(LineSource)
    source = (spark.readStream if stream else spark.read).format(FORMAT)
    return source.option("paths", path if isinstance(path, str) else "\n".join(path)).option("rangeBytes", range_bytes).load()
