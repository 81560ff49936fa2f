"""Blocked gzip: files of small gzip members that tell their size, so that a reader may begin at any block.

Members are found from a byte place by their mark and tried by their checksum. Lines belong to the split in which they
begin; the split before reads on into the next block for the rest of its last line.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: the first bytes of a member, and the bytes of text that a member holds at most here.
MARK, PAYLOAD = b"\x1f\x8b\x08\x04", 65280
#: Bytes that are asked of the file system at once, compressed bytes of a split, lines of an Arrow batch.
WINDOW, SPLIT_BYTES, BATCH_LINES = 1 << 17, 64 << 20, 1 << 16
#: Bytes that opening a file counts for when splits are dealt to tasks, and rows up to which small batches are put together.
OPEN_BYTES, JOINED_ROWS = 1 << 15, 1 << 14


def open_files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it, of a path or a URI."""
    if ":" in uri.split("/", 1)[0]:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(uri)


def listed(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """(URI or path, bytes) of a file, or of the files of a folder whose names end so, by name."""
    system, path = open_files(uri)
    front = uri[: len(uri) - len(path)] if uri.endswith(path) else uri.partition(":")[0] + "://"
    info = system.get_file_info(path)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pyarrow.fs.FileType.File:
        return [(uri, info.size)]
    found = system.get_file_info(pyarrow.fs.FileSelector(path))
    return sorted((front + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def member(data: bytes) -> bytes:
    """One member with at most PAYLOAD bytes of data; without any, the end mark of a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MARK + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The members of one open file. `fetched` counts the bytes that were asked for."""

    def __init__(self, uri: str):
        system, path = open_files(uri)
        self.file = system.open_input_file(path)
        self.size, self.fetched = self.file.size(), 0
        self._at, self._held = 0, b""

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bytes_at(self, at: int, n: int) -> bytes:
        """n bytes from a place, fewer at the end of the file."""
        if not self._at <= at <= at + n <= self._at + len(self._held):
            self._at, self._held = at, self.file.read_at(min(max(n, WINDOW), self.size - at), at) if at < self.size else b""
            self.fetched += len(self._held)
        return self._held[at - self._at : at - self._at + n]

    def length(self, at: int) -> tuple[int, int] | None:
        """(bytes of the head, of the whole member) if one seems to begin here."""
        head = self.bytes_at(at, 12)
        if len(head) < 12 or head[:4] != MARK:
            return None
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, i = self.bytes_at(at + 12, extra), 0
        while i + 4 <= len(fields):
            n = struct.unpack_from("<H", fields, i + 2)[0]
            if fields[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(fields):
                return 12 + extra, struct.unpack_from("<H", fields, i + 4)[0] + 1
            i += 4 + n
        return None

    def read(self, at: int) -> tuple[bytes, int] | None:
        """(data, place of the next member) of the member here; None at the end of the file."""
        if at >= self.size:
            return None
        lengths = self.length(at)
        raw = self.bytes_at(at, lengths[1]) if lengths else b""
        if not lengths or len(raw) < lengths[1]:
            raise ValueError(f"no whole member at {at}")
        data = zlib.decompress(raw[lengths[0] : -8], -15)
        if struct.unpack("<II", raw[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the member at {at} is damaged")
        return data, at + lengths[1]

    def first(self, at: int) -> int:
        """Where the first member at or after a place begins; the size of the file if none does."""
        while 0 < at < self.size:
            window = self.bytes_at(at, min(WINDOW, self.size - at))
            i = window.find(MARK)
            if i < 0:
                at += max(1, len(window) - len(MARK) + 1)
                continue
            try:
                self.read(at + i)
                return at + i
            except (ValueError, zlib.error):
                at += i + 1
        return min(at, self.size)


def _whole(blocks: Blocks) -> Iterator[bytes]:
    """Data of a gzip file that is not blocked, or of plain text, from its start."""
    gzip = blocks.bytes_at(0, 2) == MARK[:2]
    unpacker = zlib.decompressobj(31)
    for at in range(0, blocks.size, WINDOW):
        raw = blocks.bytes_at(at, min(WINDOW, blocks.size - at))
        if not gzip:
            yield raw
            continue
        while raw:
            yield unpacker.decompress(raw)
            raw = unpacker.unused_data
            if unpacker.eof and raw:
                unpacker = zlib.decompressobj(31)


def lines(blocks: Blocks, begin: int, end: int) -> Iterator[list[bytes]]:
    """The lines that begin in members that start in [begin, end), in lists; of a file that is not blocked all, for begin 0."""
    blocked = blocks.length(0) is not None
    if not blocked and begin:
        return

    def parts() -> Iterator[tuple[bytes, bool]]:
        """(data, whether it lies beyond the split)."""
        if not blocked:
            yield from ((x, False) for x in _whole(blocks))
            return
        at = blocks.first(begin)
        if at >= end:
            return
        while (found := blocks.read(at)) is not None:
            yield found[0], at >= end
            at = found[1]

    rest, skipped, many = b"", begin == 0, []
    for data, beyond in parts():
        if not skipped:  # the line before began in another split, unless that ended with its last byte: it reads it too
            cut = data.find(b"\n")
            if beyond:
                return
            if cut < 0:
                continue
            data, skipped = data[cut + 1 :], True
        if beyond:
            cut = data.find(b"\n")
            if cut >= 0:
                many.append(rest + data[:cut])
                yield many
                return
            rest += data
            continue
        own = (rest + data).split(b"\n")
        rest = own.pop()
        many += own
        if len(many) >= BATCH_LINES:
            yield many
            many = []
    if rest:
        many.append(rest)
    if many:
        yield many


class Splits(InputPartition):
    """The splits (path, begin, end) that one task reads, one after another."""

    def __init__(self, splits: list[tuple[str, int, int | None]]):
        self.splits = splits


def dealt(splits: list[tuple[str, int, int | None]], sizes: list[int], tasks: int) -> list[InputPartition]:
    """Splits, with their bytes, put together in order for at least `tasks` tasks if there are as many splits, and for more
    where a task would have over SPLIT_BYTES. So the number of tasks grows with the bytes, not with the number of files."""
    cost = [n + OPEN_BYTES for n in sizes]
    most = min(SPLIT_BYTES, sum(cost) // max(1, tasks))
    out: list[list[tuple[str, int, int | None]]] = []
    full = 0
    for one, n in zip(splits, cost, strict=True):
        if not out or full + n > most:
            out.append([])
            full = 0
        out[-1].append(one)
        full += n
    return [Splits(x) for x in out]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows put together to about JOINED_ROWS."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= JOINED_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tasks_wanted(spark: SparkSession) -> str:
    """A few tasks for each core, as an option of a reader."""
    return str(4 * spark.sparkContext.defaultParallelism)


class LinesSource(DataSource):
    """Format `bgzf_lines`. Reading: (path, value) of the lines of compressed files; options path, suffix, splitBytes, tasks
    (fewest tasks, if there are as many splits), only (`paths`: one row a file, without its lines, which are not read).
    Writing: (name, value) to files of a folder, lines in the order of tasks and rows; option path."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LinesReader({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _LinesWriter(dict(self.options)["path"])


class _LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        step = int(self.options.get("splitbytes") or SPLIT_BYTES)
        files, paths = listed(self.options["path"], self.options.get("suffix", "")), self.options.get("only") == "paths"
        each = [(path, at, min(at + step, size)) for path, size in files for at in ((0,) if paths else range(0, size, step))]
        return dealt(each, [0 if paths else end - begin for _, begin, end in each], int(self.options.get("tasks") or 1))

    def read(self, partition: Splits | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: no files
            yield from joined(self._batches(partition.splits))

    def _batches(self, splits: list[tuple[str, int, int | None]]) -> Iterator[pa.RecordBatch]:
        names = ["path", "value"]
        for path, begin, end in splits:
            if self.options.get("only") == "paths":
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.nulls(1, pa.string())], names=names)
                continue
            with Blocks(path) as blocks:
                for some in lines(blocks, begin, end):
                    values = pa.array([x.decode("utf-8", "replace") for x in some], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(values), pa.string()), values], names=names)


def _reader(spark: SparkSession, path: str, suffix: str) -> DataFrameReader:
    spark.dataSource.register(LinesSource)
    return spark.read.format("bgzf_lines").option("path", path).option("suffix", suffix).option("tasks", tasks_wanted(spark))


def read_lines(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, value) of the lines of a file or of a folder's files. Blocked files are read by several tasks; gzip files
    without blocks, and plain text, by one each; a task reads many small files."""
    return _reader(spark, path, suffix).option("splitBytes", str(split_bytes)).load()


def paths(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path) of the files that read_lines reads, as it names them; nothing in them is read."""
    return _reader(spark, path, suffix).option("only", "paths").load().select("path")


def staging(system: pyarrow.fs.FileSystem, folder: str) -> str:
    """A new folder in `folder` for the running task: many tasks that make files in one folder wait for each other, while
    moving a file is quick. Readers pass over it."""
    from pyspark import TaskContext

    own = f"{folder.rstrip('/')}/_task-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
    system.create_dir(own)
    return own


def cleared(system: pyarrow.fs.FileSystem, folders: list[str]) -> None:
    """Deletes tasks' folders."""
    for folder in folders:
        if system.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(folder)


@dataclass
class _Parts(WriterCommitMessage):
    """(name of the file, task, part) of what a task wrote, and the folder with the parts."""

    parts: list[tuple[str, int, str]]
    folder: str


class _LinesWriter(DataSourceArrowWriter):
    """Each task writes its lines of each file as members of a part, or as they are where the name does not end in .gz; the
    commit puts parts one behind another, which is a file of the same format. A file with one part is only renamed."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        system, inner = open_files(self.path)
        folder = staging(system, inner)
        done: list[tuple[str, int, str]] = []
        out, held = None, b""

        def put(data: bytes, last: bool) -> bytes:
            """Writes what fills members, or all of it with the end mark; gives the rest."""
            if not done[-1][0].endswith(".gz"):
                out.write(data)
                return b""
            while len(data) >= PAYLOAD or (last and data):
                out.write(member(data[:PAYLOAD]))
                data = data[PAYLOAD:]
            if last:
                out.write(member(b""))
            return data

        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if not done or done[-1][0] != name:
                    if out is not None:
                        put(held, True)
                        out.close()
                    part = f"{folder}/{name}.{len(done)}"
                    done.append((name, task, part))
                    out, held = system.open_output_stream(part), b""
                held += (value or "").encode() + b"\n"
                if len(held) >= PAYLOAD:
                    held = put(held, False)
        if out is not None:
            put(held, True)
            out.close()
        return _Parts(done, folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = open_files(self.path)
        system.create_dir(inner)
        files: dict[str, list[tuple[int, str]]] = {}
        for name, task, part in (p for m in messages if m for p in m.parts):
            files.setdefault(name, []).append((task, part))
        for name, parts in files.items():
            ordered = [part for _, part in sorted(parts, key=lambda p: p[0])]
            if len(ordered) > 1:
                joined = f"{inner}/_{name}.joined"
                with system.open_output_stream(joined) as out:
                    for part in ordered:
                        with system.open_input_stream(part) as f:
                            while data := f.read(1 << 22):
                                out.write(data)
                ordered = [joined]
            system.move(ordered[0], f"{inner}/{name}")
        cleared(system, [m.folder for m in messages if m])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        cleared(open_files(self.path)[0], [m.folder for m in messages if m])


def write_lines(rows: DataFrame, path: str, by: list[str], partitions: int | None = None) -> None:
    """Writes rows(name, value, and the columns `by`) as files of a folder, in place of what was there: one for each name,
    blocked gzip where it ends in .gz, with lines in the order of `by`. Ranges of (name, by) are sorted and compressed by
    several tasks; the parts of a file are then put together as they are, bytes after bytes, by the driver."""
    spark = rows.sparkSession
    system, inner = open_files(path)
    if system.get_file_info(inner).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(inner)
    spark.dataSource.register(LinesSource)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "name", *by).sortWithinPartitions("name", *by)
    dealt.select("name", F.col("value").cast("string").alias("value")).write.format("bgzf_lines").mode("append").option("path", path).save()
