"""Text files that are still being written, as a stream of their finished lines.

A line belongs to the byte range that holds its line feed, so a range can be cut anywhere: the reader of a range looks back for the
beginning of its first line, and what follows its last line feed is left to a later range.  An unfinished last line
is thus held back until it ends, and a long range is read by many tasks.  Short ranges, as a fleet of many small logs has them,
are read many to a task: the number of tasks follows the bytes and the files to open, not the files alone.

The offset of the stream is the size of each file.  With a folder for ``listings`` it is only the name of a table there, sorted by file,
and the ranges of a batch are a table too, of which each task reads its own rows: the driver and its Python hold a name and a
size for each file while they list and sort them, and no list of files is pickled, logged or sent.  A file that became shorter was
replaced and is read from its start; one that is gone leaves the offset.  Names that log rotation gives to old files should not match the
pattern, or their lines would come again under the new name.  Paths are anything pyarrow's file systems open.
"""

from __future__ import annotations

import fnmatch
import os
import sys
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
#: What opening a file counts beside its bytes where ranges are dealt out to tasks.
OPEN_BYTES = 64 << 10
SCHEMA = "file string, at bigint, value string"
#: Files of a listing in one batch.
LISTED_ROWS = 1 << 16


class Range:
    """Bytes ``start`` up to ``stop`` of a file."""

    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class Planned(InputPartition):
    """What one task reads, as one batch of a written plan."""

    def __init__(self, plan: str, at: int):
        self.plan, self.at = plan, at

    @property
    def ranges(self) -> list[Range]:
        system, path = open_file_system(self.plan)
        with system.open_input_file(path) as source:
            batch = pa.ipc.open_file(source).get_batch(self.at)
        return [Range(*row) for row in zip(*[c.to_pylist() for c in batch.columns])]


def open_file_system(path: str):
    """The file system of a path or URL, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(system, folder: str) -> Iterator[tuple[str, int | None]]:
    """The names in a folder with the sizes of files, none for folders; a local folder is never held as a whole."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        try:
            scanned = os.scandir(folder)
        except FileNotFoundError:
            return
        with scanned:
            for entry in scanned:
                try:
                    if entry.is_dir():
                        yield entry.name, None
                    elif entry.is_file():
                        yield entry.name, entry.stat().st_size
                except FileNotFoundError:  # gone meanwhile
                    continue
    else:
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.is_file or f.type == fs.FileType.Directory:
                yield f.base_name, f.size if f.is_file else None


def files(path: str, pattern: str) -> Iterator[tuple[str, int]]:
    """The files below a folder whose names match, by their paths in it, with their sizes; hidden ones are left out."""
    system, folder = open_file_system(path)
    inner = [""]
    while inner:
        at = inner.pop()
        for name, size in entries(system, f"{folder.rstrip('/')}/{at}"):
            if size is None:
                inner.append(f"{at}{name}/")
            elif fnmatch.fnmatch(name, pattern) and not name.startswith(("_", ".")):
                yield f"{at}{name}", size


def sizes(path: str, pattern: str) -> dict[str, int]:
    """The files below a folder whose names match, with their sizes."""
    folder = open_file_system(path)[1].rstrip("/")
    return {f"{folder}/{name}": size for name, size in files(path, pattern)}


def listing(path: str, pattern: str) -> pa.Table:
    """``name, size`` of the files below a folder, sorted by name."""
    schema = pa.schema([("name", pa.large_string()), ("size", pa.int64())])
    batches, names, numbers = [], [], []

    def close() -> None:
        batches.append(pa.record_batch([pa.array(names, pa.large_string()), pa.array(numbers, pa.int64())], schema=schema))
        names.clear()
        numbers.clear()

    for name, size in files(path, pattern):
        names.append(name)
        numbers.append(size)
        if len(names) == LISTED_ROWS:
            close()
    close()
    return pa.Table.from_batches(batches).sort_by("name")


def write_batches(folder: str, name: str, schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> int:
    """A file of batches, put in place when it is whole; the number of batches."""
    system, base = open_file_system(folder)
    system.create_dir(base)
    count = 0
    with system.open_output_stream(f"{base}/_{name}") as out:
        with pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in batches:
                writer.write_batch(batch)
                count += 1
    system.move(f"{base}/_{name}", f"{base}/{name}")
    return count


def read_batches(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    system, base = open_file_system(folder)
    with system.open_input_file(f"{base}/{name}") as source:
        reader = pa.ipc.open_file(source)
        for at in range(reader.num_record_batches):
            yield reader.get_batch(at)


def is_listing(offset: dict) -> bool:
    """Whether an offset names a listing; else its values are sizes, as all were once."""
    return isinstance(offset.get("listing"), str)


def kept_listings(folder: str) -> list[str]:
    """The names of the listings in a folder, oldest first."""
    return sorted(name for name, size in entries(*open_file_system(folder)) if size is not None and name.startswith("listing-"))


def keep_listing(folder: str, found: pa.Table) -> str:
    """The name of a listing: that of the newest if nothing has changed, else it is written."""
    kept = kept_listings(folder)
    if kept:
        at = 0
        for batch in read_batches(folder, kept[-1]):
            if not pa.Table.from_batches([batch]).equals(found.slice(at, batch.num_rows)):
                break
            at += batch.num_rows
        else:
            if at == found.num_rows:
                return kept[-1]
    name = f"listing-{int(kept[-1].split('-')[1]) + 1 if kept else 0:012}"
    write_batches(folder, name, found.schema, found.to_batches(LISTED_ROWS))
    return name


def new_ranges(start: Iterable[tuple[str, int]], end: Iterable[tuple[str, int]], split_bytes: int) -> Iterator[Range]:
    """The byte ranges written between two lists of files and sizes that are sorted by file."""
    earlier = iter(start)
    known = next(earlier, None)
    for file, size in end:
        while known is not None and known[0] < file:
            known = next(earlier, None)
        at = known[1] if known is not None and known[0] == file else 0
        at = 0 if size < at else at
        for a in range(at, size, split_bytes):
            yield Range(file, a, min(a + split_bytes, size))


def grown(start: dict[str, int], end: dict[str, int], split_bytes: int) -> list[Range]:
    """The byte ranges written since ``start``."""
    return list(new_ranges(sorted(start.items()), sorted(end.items()), split_bytes))


def dealt(ranges: Iterable[Range], split_bytes: int, open_bytes: int = OPEN_BYTES) -> Iterator[list[Range]]:
    """The ranges in their order, as many to a task as make ``split_bytes`` with the opening of their files."""
    some, held = [], 0
    for r in ranges:
        cost = r.stop - r.start + open_bytes
        if some and held + cost > split_bytes:
            yield some
            some, held = [], 0
        some.append(r)
        held += cost
    if some:
        yield some


def packed(ranges: Sequence[Range], split_bytes: int, open_bytes: int = OPEN_BYTES) -> list[Ranges]:
    return [Ranges(some) for some in dealt(ranges, split_bytes, open_bytes)]


def line_start(source, at: int) -> int:
    """Where the line begins that the byte before ``at`` belongs to, or that begins at ``at``."""
    while at > 0:
        size = min(CHUNK_BYTES, at)
        source.seek(at - size)
        found = source.read(size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


def lines(source, start: int, stop: int) -> Iterator[list[tuple[int, bytes]]]:
    """The lines that end in a range, with their places, in batches of about ``CHUNK_BYTES``."""
    at, begun, rest = start, None, b""
    while at < stop:
        source.seek(at)
        data = source.read(min(CHUNK_BYTES, stop - at))
        if not data:
            return
        last = data.rfind(b"\n")
        if last < 0:
            if begun is not None:
                rest += data
        else:
            if begun is None:
                begun = line_start(source, at)
                source.seek(begun)
                rest = source.read(at - begun)
            whole, place, out = rest + data[: last + 1], begun, []
            for line in whole.split(b"\n")[:-1]:
                out.append((place, line.removesuffix(b"\r")))
                place += len(line) + 1
            yield out
            begun, rest = place, data[last + 1 :]
        at += len(data)


def record_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    file, at, value = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(value, pa.string())], names=["file", "at", "value"]
    )


class GrowingTextReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, split_bytes: int, listings: str | None = None):
        self.path, self.pattern, self.split_bytes, self.listings = path, pattern, split_bytes, listings

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.listings is None:
            return sizes(self.path, self.pattern)
        return {"listing": keep_listing(self.listings, listing(self.path, self.pattern))}

    def listed(self, offset: dict) -> Iterator[tuple[str, int]]:
        """The files of an offset and their sizes, sorted by file."""
        if not is_listing(offset):
            yield from sorted(offset.items())
            return
        folder = open_file_system(self.path)[1].rstrip("/")
        for batch in read_batches(self.listings, offset["listing"]):
            for name, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield f"{folder}/{name}", size

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        tasks = dealt(new_ranges(self.listed(start), self.listed(end), self.split_bytes), self.split_bytes)
        if not is_listing(end):
            return [Ranges(some) for some in tasks]
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        name = end["listing"].replace("listing-", "plan-")
        batches = (pa.record_batch(list(zip(*[(r.file, r.start, r.stop) for r in some])), schema=schema) for some in tasks)
        count = write_batches(self.listings, name, schema, batches)
        return [Planned(f"{self.listings}/{name}", at) for at in range(count)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = open_file_system(self.path)
        rows, held = [], 0
        for r in partition.ranges:
            with system.open_input_file(r.file) as source:
                for found in lines(source, r.start, r.stop):
                    rows += [(r.file, at, line.decode("utf-8", "replace")) for at, line in found]
                    held += sum(len(r.file) + len(line) for _, line in found)
                    if held >= CHUNK_BYTES:
                        yield record_batch(rows)
                        rows, held = [], 0
        if rows:
            yield record_batch(rows)

    def commit(self, end: dict) -> None:
        """Give up what came before an offset; log files are kept by those who write them."""
        if is_listing(end):
            system, base = open_file_system(self.listings)
            for name, _ in list(entries(system, base)):
                if name.startswith(("listing-", "plan-")) and name.split("-")[1] < end["listing"].split("-")[1]:
                    system.delete_file(f"{base}/{name}")


class GrowingText(DataSource):
    """``spark.readStream.format("growing_text")`` with options ``path``, ``pattern``, ``splitBytes`` and ``listings``."""

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingTextReader(
            self.options["path"], self.options.get("pattern", "*"), int(self.options.get("splitBytes", SPLIT_BYTES)),
            self.options.get("listings"),
        )


def growing_text(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES, listings: str | None = None):
    """A stream of ``file, at, value``: the finished lines of files as they grow; ``at`` is where a line begins.

    ``listings`` is a folder of the stream's own that the driver and the executors reach; without one the offset holds all files.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(GrowingText)
    source = spark.readStream.format("growing_text").option("path", path)
    source = source if listings is None else source.option("listings", listings)
    return source.option("pattern", pattern).option("splitBytes", str(split_bytes)).load()
