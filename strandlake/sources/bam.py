"""BAM files: written by ranges of position with an index each, and read by region so that only the chunks that the index
names are opened.

The index is the public binning index: bins of six sizes hold the chunks of the records that lie in them, and a linear
index tells for windows of 2**14 places where the first record that reaches into one lies. Places in a file are virtual:
the byte of a block, shifted by 16, and the byte inside it. A file is dealt to tasks by ranges of bytes; a task takes the
records from the first place of the linear index in its range to the first in the next, so none is read twice.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandlake.sources.bgzf import PAYLOAD, SPLIT_BYTES, Blocks, Splits, cleared, dealt, joined, listed, member, open_files, staging, tasks_wanted

#: Fixed values of the format: bits of the smallest bin and of a window, levels of bins, letters of CIGAR operations, and
#: those that cover places of the reference.
WINDOW_BITS, LEVELS, OPERATIONS, COVERING = 14, 6, "MIDNSHP=X", (0, 2, 3, 7, 8)
#: Bytes of records that are decoded together.
DECODED = 4 << 20

FIELDS = ("sample_id", "chrom", "pos", "flag", "mapq", "next_chrom", "end", "cigar")
SCHEMA = "sample_id string, chrom string, pos long, flag int, mapq int, next_chrom string, end long, cigar string"

_FIXED = np.dtype([
    ("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"),
    ("seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("span", "<i4"),
])


def _level(k: int) -> tuple[int, int]:
    """(number of the first bin of a level, bits of its bins); level 0 is one bin."""
    return (8**k - 1) // 7, WINDOW_BITS + 3 * (LEVELS - 1 - k)


def smallest_bin(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bin that holds each half-open range."""
    out = np.zeros(len(begin), np.int64)
    for k in range(1, LEVELS):
        first, bits = _level(k)
        out = np.where(begin >> bits == (end - 1) >> bits, first + (begin >> bits), out)
    return out


def touched_bins(begin: int, end: int) -> set[int]:
    """All bins that a half-open range touches."""
    return {first + i for first, bits in map(_level, range(LEVELS)) for i in range(begin >> bits, ((end - 1) >> bits) + 1)}


class Index:
    """Chunks by bin and the linear index of each reference."""

    def __init__(self, bins: list[dict[int, list[tuple[int, int]]]], windows: list[list[int]]):
        self.bins, self.windows = bins, windows
        self.places = sorted({w for own in windows for w in own if w})

    @classmethod
    def read(cls, uri: str) -> Index:
        system, path = open_files(uri)
        with system.open_input_stream(path) as f:
            raw = f.read()
        if raw[:4] != b"BAI\1":
            raise ValueError(f"{uri} is no BAM index")
        at, bins, windows = 8, [], []
        for _ in range(struct.unpack_from("<i", raw, 4)[0]):
            own: dict[int, list[tuple[int, int]]] = {}
            (n,), at = struct.unpack_from("<i", raw, at), at + 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", raw, at)
                flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
                own[number] = list(zip(flat[::2], flat[1::2], strict=True))
                at += 8 + 16 * chunks
            (n,) = struct.unpack_from("<i", raw, at)
            windows.append(list(struct.unpack_from(f"<{n}Q", raw, at + 4)))
            at += 4 + 8 * n
            bins.append(own)
        return cls(bins, windows)

    def packed(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for own, windows in zip(self.bins, self.windows, strict=True):
            out.append(struct.pack("<i", len(own)))
            for number, chunks in sorted(own.items()):
                out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(v for c in chunks for v in c)))
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        return b"".join(out)

    def chunks(self, ref: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual places that can hold records over [begin, end), in order and apart."""
        if not 0 <= ref < len(self.bins) or begin >= end:
            return []
        known = [w for w in self.windows[ref][: (begin >> WINDOW_BITS) + 1] if w]
        least = known[-1] if known else 0
        out: list[tuple[int, int]] = []
        # Bins beyond the levels hold statistics of some writers, not records: none of them is touched.
        for a, b in sorted(c for number in touched_bins(begin, end) & self.bins[ref].keys() for c in self.bins[ref][number] if c[1] > least):
            a = max(a, least)
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out

    def next_place(self, byte: int) -> int | None:
        """The first virtual place of the linear index in a block that starts at or after a byte of the file."""
        i = bisect_left(self.places, byte << 16)
        return self.places[i] if i < len(self.places) else None


def read_header(blocks: Blocks) -> tuple[list[str], int]:
    """(names of the references, virtual place of the first record)."""
    data, ends, at = b"", [], 0

    def need(n: int) -> None:
        nonlocal data, at
        while len(data) < n:
            found = blocks.read(at)
            if found is None:
                raise ValueError("the header is cut off")
            ends.append((len(data), at))
            data, at = data + found[0], found[1]

    need(8)
    if data[:4] != b"BAM\1":
        raise ValueError("no BAM file")
    p = 8 + struct.unpack_from("<i", data, 4)[0]
    need(p + 4)
    n, p, names = struct.unpack_from("<i", data, p)[0], p + 4, []
    for _ in range(n):
        need(p + 4)
        size = struct.unpack_from("<i", data, p)[0]
        need(p + 8 + size)
        names.append(data[p + 4 : p + 3 + size].decode())
        p += 8 + size
    if p == len(data):
        return names, at << 16
    begin, block = [e for e in ends if e[0] <= p][-1]
    return names, block << 16 | p - begin


def _records(blocks: Blocks, begin: int, end: int | None) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, where records begin in them) of the records from one virtual place up to another, or to the end."""
    at, skip, held, stop = begin >> 16, begin & 0xFFFF, b"", None
    while stop is None:
        parts, size = [held], len(held)
        while size < DECODED and stop is None:
            if end is not None and (at > end >> 16 or at == end >> 16 and not end & 0xFFFF):
                stop = size
                break
            found = blocks.read(at)
            if found is None:
                stop = size
                break
            data = found[0][skip:]
            if end is not None and at == end >> 16:
                stop = size + (end & 0xFFFF) - skip
            parts.append(data)
            size, at, skip = size + len(data), found[1], 0
        data = b"".join(parts)
        limit, p, starts = len(data) if stop is None else stop, 0, []
        unpack = struct.Struct("<i").unpack_from
        while p + 4 <= limit:
            n = unpack(data, p)[0] + 4
            if p + n > len(data):
                break
            starts.append(p)
            p += n
        held = data[p:]
        yield data, np.array(starts, np.int64)


def _batch(data: bytes, starts: np.ndarray, names: list[str], sample: str) -> tuple[np.ndarray, pa.RecordBatch]:
    """(numbers of references, the columns) of records."""
    raw = np.frombuffer(data, np.uint8)
    x = raw[starts[:, None] + np.arange(_FIXED.itemsize)].reshape(-1).view(_FIXED)
    ops = x["ops"].astype(np.int64)
    first = np.cumsum(ops) - ops
    where = np.repeat(starts + _FIXED.itemsize + x["name"] - 4 * first, ops) + 4 * np.arange(int(ops.sum()))
    op = raw[where[:, None] + np.arange(4)].reshape(-1).view("<u4") if len(where) else np.zeros(0, "<u4")
    length, code = (op >> 4).astype(np.int64), op & 15
    sums = np.append(0, np.cumsum(np.where(np.isin(code, COVERING), length, 0)))
    pos = x["pos"].astype(np.int64)
    end = pos + np.maximum(1, sums[first + ops] - sums[first])
    told = [f"{n}{OPERATIONS[c]}" for n, c in zip(length.tolist(), code.tolist(), strict=True)]
    cigars = ["".join(told[a : a + n]) or "*" for a, n in zip(first.tolist(), ops.tolist(), strict=True)]
    chrom = pa.array([*names, None], pa.string())
    columns = {
        "sample_id": pa.array([sample] * len(x), pa.string()), "chrom": chrom.take(pa.array(np.where(x["ref"] < 0, len(names), x["ref"]))), "pos": pa.array(pos),
        "flag": pa.array(x["flag"].astype(np.int32)), "mapq": pa.array(x["mapq"].astype(np.int32)),
        "next_chrom": chrom.take(pa.array(np.where(x["next_ref"] < 0, len(names), x["next_ref"]))), "end": pa.array(end), "cigar": pa.array(cigars, pa.string()),
    }
    return x["ref"].astype(np.int64), pa.RecordBatch.from_pydict(columns)


def read_part(blocks: Blocks, index: Index | None, sample: str, begin: int = 0, end: int | None = None, region: tuple[str, int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The records of a range of bytes of a file; of a region only those that overlap it, by way of the index. Without an
    index the task that has the file's first byte reads all of it."""
    names, start = read_header(blocks)
    if index is None:
        if begin:
            return
        low, high = start, None
    else:
        low = start if not begin else index.next_place(begin)
        high = index.next_place(end) if end is not None else None
        if low is None or (high is not None and low >= high):
            return
    spans: list[tuple[int, int | None]] = [(low, high)]
    if region and (index is None or region[0] not in names):
        spans = spans if region[0] in names else []
    elif region:
        own = index.chunks(names.index(region[0]), region[1], region[2])
        spans = [(max(a, low), b if high is None else min(b, high)) for a, b in own if b > low and (high is None or a < high)]
    for a, b in spans:
        for data, starts in _records(blocks, a, b):
            if not len(starts):
                continue
            ref, batch = _batch(data, starts, names, sample)
            if region is None:
                yield batch
                continue
            own, pos = ref == names.index(region[0]), batch.column("pos").to_numpy()
            keep = own & (batch.column("end").to_numpy() > region[1]) & (pos < region[2])
            yield batch.filter(pa.array(keep))
            if index is not None and own[-1] and pos[-1] >= region[2]:  # in order: nothing more overlaps
                break


class BamSource(DataSource):
    """Format `bam`. Reading: options path (a file or a folder), region as chrom:start-end (half-open, from 0), splitBytes,
    tasks (fewest tasks, if there are as many splits), broken (`mark`: a file that is no sound BAM gives a row with its
    sample alone in place of an error).
    Writing: references, a JSON object of names and lengths; rows must come in order of sample, reference and position."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BamWriter({k.lower(): v for k, v in dict(self.options).items()})


class _BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        told = options.get("region")
        chrom, _, span = told.rpartition(":") if told else ("", "", "")
        self.region = (chrom, *map(int, span.split("-"))) if told else None

    def partitions(self) -> list[InputPartition]:
        step = int(self.options.get("splitbytes") or SPLIT_BYTES)
        each = [(path, at, size) for path, size in listed(self.options["path"], ".bam") for at in range(0, max(1, size), step)]
        splits = [(path, at, at + step if at + step < size else None) for path, at, size in each]
        return dealt(splits, [min(step, size - at) for _, at, size in each], int(self.options.get("tasks") or 1))

    def read(self, part: Splits | None) -> Iterator[pa.RecordBatch]:
        if part is not None:  # None: no files
            yield from joined(batch for split in part.splits for batch in self._batches(*split))

    def _batches(self, path: str, begin: int, end: int | None) -> Iterator[pa.RecordBatch]:
        system, inner = open_files(path)
        beside = [p for p in (f"{path}.bai", f"{path[:-4]}.bai") if system.get_file_info(open_files(p)[1]).type == pa.fs.FileType.File]
        sample = inner.rsplit("/", 1)[-1].split(".", 1)[0]
        try:
            with Blocks(path) as blocks:
                yield from read_part(blocks, Index.read(beside[0]) if beside else None, sample, begin, end, self.region)
        except (ValueError, IndexError, UnicodeDecodeError, struct.error, zlib.error) as e:
            if self.options.get("broken") != "mark":
                raise ValueError(f"{path}: {e}") from e
            row = {f: pa.array([sample if f == "sample_id" else None], pa.string() if f in ("sample_id", "chrom", "next_chrom", "cigar") else pa.int64() if f in ("pos", "end") else pa.int32()) for f in FIELDS}
            yield pa.RecordBatch.from_pydict(row)


class _File:
    """A BAM file in the making: records go to blocks as they come, the index is gathered in runs."""

    def __init__(self, path: str, names: list[str], lengths: list[int]):
        self.path, self.names = path, names
        self.system, self.inner = open_files(path)
        self.out = self.system.open_output_stream(self.inner)
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in zip(names, lengths, strict=True))
        own = b"".join(struct.pack(f"<i{len(n) + 1}si", len(n) + 1, n.encode(), size) for n, size in zip(names, lengths, strict=True))
        self.held, self.places, self.written, self.gone, self.count = b"", [], 0, 0, 0
        self.runs: list[np.ndarray] = []
        self.windows: list[np.ndarray] = []
        self._add(b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(names)) + own, True)

    def _add(self, data: bytes, whole: bool = False) -> None:
        self.held += data
        while len(self.held) >= PAYLOAD or (whole and self.held):
            self._block(self.held[:PAYLOAD])
            self.held = self.held[PAYLOAD:]

    def _block(self, data: bytes) -> None:
        packed = member(data)
        self.places.append((self.gone, self.written))
        self.out.write(packed)
        self.written, self.gone = self.written + len(packed), self.gone + len(data)

    def add(self, ref: np.ndarray, pos: np.ndarray, end: np.ndarray, sizes: np.ndarray, data: bytes) -> None:
        at = self.gone + len(self.held) + np.append(0, np.cumsum(sizes))
        known = np.flatnonzero(ref >= 0)
        number = smallest_bin(pos[known], end[known])
        new = np.flatnonzero(np.append(True, (ref[known][1:] != ref[known][:-1]) | (number[1:] != number[:-1]))) if len(known) else known
        last = np.append(new[1:], len(known)) - 1
        self.runs.append(np.stack([ref[known][new], number[new], at[known[new]], at[known[last] + 1]]).T)
        first, after = pos[known] >> WINDOW_BITS, ((end[known] - 1) >> WINDOW_BITS) + 1
        n = after - first
        window = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key = np.stack([np.repeat(ref[known], n), window, np.repeat(at[known], n)]).T
        order = np.lexsort(key.T[::-1])
        key = key[order]
        once = np.append(True, (key[1:, :2] != key[:-1, :2]).any(axis=1)) if len(key) else np.zeros(0, bool)
        self.windows.append(key[once])
        self.count += len(ref)
        self._add(data)

    def close(self) -> tuple[str, int, int]:
        self._add(b"", True)
        self.out.write(member(b""))
        self.out.close()
        flat, packed = (np.array([p[i] for p in self.places], np.int64) for i in (0, 1))

        def virtual(at: np.ndarray) -> np.ndarray:
            """A place right behind the last block is the place of the end mark."""
            block = np.searchsorted(flat, at, side="right") - 1
            inside = at - flat[block]
            beyond = at >= self.gone
            return np.where(beyond, self.written << 16, packed[block] << 16 | inside)

        bins: list[dict[int, list[tuple[int, int]]]] = [{} for _ in self.names]
        for ref, number, a, b in (x for runs in self.runs for x in zip(*runs[:, :2].T.tolist(), virtual(runs[:, 2]).tolist(), virtual(runs[:, 3]).tolist(), strict=True)):
            own = bins[ref].setdefault(number, [])
            if own and own[-1][1] == a:
                own[-1] = own[-1][0], b
            else:
                own.append((a, b))
        windows: list[list[int]] = [[] for _ in self.names]
        for ref, w, v in (x for own in self.windows for x in zip(*own[:, :2].T.tolist(), virtual(own[:, 2]).tolist(), strict=True)):
            own = windows[ref]
            own += [0] * (w + 1 - len(own))
            own[w] = own[w] or v
        with self.system.open_output_stream(f"{self.inner}.bai") as out:
            out.write(Index(bins, windows).packed())
        return self.inner, self.count, self.written


def _encoded(batch: pa.RecordBatch, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(reference, position, end, sizes, bytes) of rows as records without name and sequence. Without a CIGAR a row is one
    stretch from pos to end, or without that of one place."""
    n, have = batch.num_rows, batch.schema.names
    names = lambda c: np.array([number[v] if v is not None else -1 for v in batch.column(c).to_pylist()], np.int64)
    ref, pos = names("chrom"), batch.column("pos").to_numpy().astype(np.int64)
    if "cigar" in have:
        unique = batch.column("cigar").dictionary_encode()
        letters = {c: i for i, c in enumerate(OPERATIONS)}
        parsed = [np.array(_operations(c, letters), np.uint32) for c in unique.dictionary.to_pylist()]
        which = unique.indices.to_numpy()
        ops = np.array([len(p) for p in parsed], np.int64)[which] if n else np.zeros(0, np.int64)
        cover = np.array([int((p[np.isin(p & 15, COVERING)] >> 4).sum()) for p in parsed], np.int64)
        end = pos + np.maximum(1, cover[which]) if n else pos
        flat = np.concatenate([parsed[i] for i in which.tolist()]) if n else np.zeros(0, np.uint32)
    else:
        end = np.maximum(batch.column("end").to_numpy().astype(np.int64) if "end" in have else pos + 1, pos + 1)
        ops, flat = np.ones(n, np.int64), ((end - pos) << 4).astype(np.uint32)
    x = np.zeros(n, _FIXED)
    x["size"], x["ref"], x["pos"], x["name"], x["ops"] = _FIXED.itemsize - 4 + 2 + 4 * ops, ref, pos, 2, ops
    x["mapq"], x["flag"], x["bin"] = batch.column("mapq").to_numpy(), batch.column("flag").to_numpy(), smallest_bin(np.maximum(pos, 0), np.maximum(end, 1))
    x["next_ref"], x["next_pos"] = names("next_chrom"), -1
    sizes = x["size"].astype(np.int64) + 4
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[begin[:, None] + np.arange(_FIXED.itemsize)] = np.ascontiguousarray(x).view(np.uint8).reshape(n, -1)
    out[begin + _FIXED.itemsize] = ord("*")
    first = np.cumsum(ops) - ops
    where = np.repeat(begin + _FIXED.itemsize + 2 - 4 * first, ops) + 4 * np.arange(int(ops.sum()))
    out[where[:, None] + np.arange(4)] = flat.astype("<u4").view(np.uint8).reshape(-1, 4)
    return ref, pos, end, sizes, out.tobytes()


def _operations(cigar: str | None, letters: dict[str, int]) -> list[int]:
    out, n = [], 0
    for c in "" if cigar in (None, "*") else cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append(n << 4 | letters[c])
            n = 0
    return out


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, int]], folder: str):
        self.files, self.folder = files, folder


class _BamWriter(DataSourceArrowWriter):
    """One file with its index for each sample and task, in the task's folder until the job commits."""

    def __init__(self, options: dict):
        self.path, self.references = options["path"], json.loads(options["references"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, inner = open_files(self.path)
        folder = staging(system, inner)
        base = self.path.rstrip("/") + folder[len(inner.rstrip("/")) :]
        number = {n: i for i, n in enumerate(self.references)}
        file, sample, before, done = None, None, 0, []
        for whole in batches:
            names = whole.column("sample_id").to_pylist()
            cut = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for a, b in zip(cut, [*cut[1:], len(names)], strict=True):
                if file is None or names[a] != sample:
                    if file is not None:
                        done.append(file.close())
                    sample, before = names[a], 0
                    file = _File(f"{base}/{sample}.{task:05d}-{attempt}.bam", list(self.references), list(self.references.values()))
                ref, pos, end, sizes, data = _encoded(whole.slice(a, b - a), number)
                order = np.where(ref < 0, 1 << 30, ref) << 32 | np.maximum(pos, 0)
                if (order[1:] < order[:-1]).any() or order[0] < before:
                    raise ValueError("alignments must come in order of sample, reference and position")
                before = int(order[-1])
                file.add(ref, pos, end, sizes, data)
        if file is not None:
            done.append(file.close())
        return _Written(done, folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = open_files(self.path)
        system.create_dir(folder)
        for inner, _, _ in (f for m in messages if m for f in m.files):
            final = f"{folder.rstrip('/')}/{inner.rsplit('/', 1)[-1]}"
            system.move(f"{inner}.bai", f"{final}.bai")
            system.move(inner, final)
        cleared(system, [m.folder for m in messages if m])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        cleared(open_files(self.path)[0], [m.folder for m in messages if m])


def write_bam(alignments: DataFrame, path: str, references: dict[str, int], partitions: int | None = None) -> None:
    """Writes alignments(sample_id, chrom, pos, flag, mapq, next_chrom and cigar or end) as coordinate-ordered BAM files
    with an index each, named after the sample; a sample with very many reads has several, by ranges of position.

    references: names and lengths of the references, in their order; other names are an error, a null is unplaced and
    comes last. Every executor must reach the folder.
    """
    spark = alignments.sparkSession
    spark.dataSource.register(BamSource)
    places = F.create_map(*(x for i, n in enumerate(references) for x in (F.lit(n), F.lit(i))))
    kept = [c for c in ("sample_id", "chrom", "pos", "flag", "mapq", "next_chrom", "end", "cigar") if c in alignments.columns]
    own = alignments.select(*kept, F.coalesce(F.try_element_at(places, "chrom"), F.lit(1 << 30)).alias("_ref"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["sample_id", "_ref", "pos"]
    own.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_ref").write.format("bam").mode("append").option("path", path).option("references", json.dumps(references)).save()


def read_bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, split_bytes: int = SPLIT_BYTES, mark_broken: bool = False) -> DataFrame:
    """(sample_id, chrom, pos, flag, mapq, next_chrom, end, cigar) of the BAM files of a folder, or of one; the sample is
    the name up to its first dot. region (chrom, start, end), half-open: only what overlaps it, and with an index beside
    the file only the chunks that can are opened. mark_broken: a damaged file gives, besides what was read of it, a row
    in which only the sample is known; else it ends the job."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("path", path).option("splitBytes", str(split_bytes)).option("tasks", tasks_wanted(spark)).option("broken", "mark" if mark_broken else "fail")
    return (reader.option("region", f"{region[0]}:{region[1]}-{region[2]}") if region else reader).load()
