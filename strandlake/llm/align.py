"""Alignment of two tokenizers' tokens by bytes, and counts of linked id pairs by a cogroup of postings.

Each text is encoded twice. Where tokens of both sides end at one byte the text is cut into groups; every token of side A is
linked to every token of side B in its group. Map tasks turn documents into postings: for a pair of ids the documents
that hold it linked, with multiplicities. Both the documents' numbers by pair and the postings are shuffled by the id of
side A and sorted; one pass over a sorted stream takes an id's counts first (no more than side B has ids), so the
greatest is known when its postings follow, and each document's part is given out at once. Parts are summed by document.
An id with many postings is dealt to several tasks, by the map task they come from, and its counts go to each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, materialize
from strandlake.llm.segments import Memo, byte_level, distinct, parcels, pieces, ragged

#: Entries (a pair in a document) that a map task gathers before it hands them on, and documents of one block of postings.
ENTRIES, BLOCK_ROWS = 1 << 20, 1 << 16
#: Entries of one id of side A that go to one task.
ID_ENTRIES = 1 << 20
#: An id pair as one number: ids of side B have fewer than 2**20 values.
_B_BITS = 20

_PART = np.dtype([("doc", "u2"), ("n_best", "i8"), ("count_sum", "i8")])
_LINKED = np.dtype([("a", "u4"), ("b", "u4")])
_TOLD = T.StructType([T.StructField(n, T.LongType()) for n in ("ref", "n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups", T.BinaryType())])
_POSTING = T.StructType([
    T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("base", T.LongType()),
    T.StructField("docs", T.BinaryType()), T.StructField("times", T.BinaryType()),
])


class Aligner:
    """Groups and links of segments, each segment once; side B's model adds the space that segments begin with."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_level(a_path), pieces(b_path)
        if max(len(self.a.entry), len(self.b.entry)) >= 1 << _B_BITS:
            raise ValueError("too many ids")
        self.cut = self.a.cut and self.b.cut
        self.memo = Memo(self._align)

    def _align(self, segments: list[bytes]) -> list[tuple[bytes, bytes, tuple[int, int, int]] | bool]:
        """(packed links, groups as text, (tokens of A, tokens of B, groups)) of each segment; False where the bytes of a
        side's tokens are not the segment's."""
        a, b = self.a.encode(segments), self.b.encode(segments)
        ids = lambda x: memoryview(x).cast("I")
        ok = [b"".join([self.a.entry[i] for i in ids(x)]) == s == b"".join([self.b.entry[i] for i in ids(y)]) for x, y, s in zip(a, b, segments, strict=True)]
        out: list = [False] * len(segments)
        good = [i for i, o in enumerate(ok) if o]
        if not good:
            return out
        n_a, n_b = (np.array([len(side[i]) // 4 for i in good]) for side in (a, b))
        a_ids, b_ids = (np.frombuffer(b"".join([side[i] for i in good]), np.uint32) for side in (a, b))
        a_end, b_end = np.cumsum(self.a.size[a_ids]), np.cumsum(self.b.size[b_ids])
        both = np.intersect1d(a_end, b_end, assume_unique=False)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        a_count, b_count = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        b_first = np.cumsum(b_count) - b_count
        links = np.empty(int((a_count * b_count).sum()), _LINKED)
        links["a"] = np.repeat(a_ids, b_count[a_group])
        links["b"] = b_ids[ragged(b_first[a_group], b_count[a_group])]
        links_of = np.bincount(np.repeat(np.arange(len(good)), n_a), weights=b_count[a_group], minlength=len(good)).astype(np.int64)
        groups_of = np.diff(np.append(0, np.searchsorted(both, a_end[np.cumsum(n_a) - 1]) + 1))
        told = []
        i = j = 0
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        for x, y in zip(a_count.tolist(), b_count.tolist(), strict=True):
            told.append(f"{','.join(a_text[i : i + x])}|{','.join(b_text[j : j + y])}" if x + y > 2 else f"{a_text[i]}|{b_text[j]}")
            i, j = i + x, j + y
        raw, at, g = links.tobytes(), 0, 0
        for k, m, c, x, y in zip(good, links_of.tolist(), groups_of.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
            out[k] = raw[at : at + 8 * m], ";".join(told[g : g + c]).encode(), (x, y, c)
            at, g = at + 8 * m, g + c
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path)


class _Postings:
    """Entries (pair, document, times) of a block of documents, and its rows of postings."""

    def __init__(self, base: int):
        self.base, self.parts, self.size = base, [], 0

    def add(self, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> None:
        if len(pair):
            self.parts.append((pair, doc, times))
            self.size += len(pair)

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries in order of pair and document, one for both."""
        pair, doc, times = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((doc, pair))
        pair, doc, times = pair[order], doc[order], times[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))
        self.parts = [(pair[first], doc[first], np.add.reduceat(times, first))]
        self.size = len(first)
        return self.parts[0]

    def drop(self, doc: int) -> None:
        self.parts = [tuple(c[p[1] != doc] for c in p) for p in self.parts]
        self.size = sum(len(p[0]) for p in self.parts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each pair; times that fit one byte and others apart."""
        if not self.size:
            return
        pair, doc, times = self.compact()
        for some, kind in ((times < 256, np.uint8), (times >= 256, np.int64)):
            key, d, m = pair[some], doc[some].astype(np.uint16), times[some].astype(kind)
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(first, len(key))
            for at in range(0, len(first), 1 << 15):
                cut = ends[at : at + (1 << 15) + 1]
                own = key[cut[:-1]]
                columns = [(own >> np.uint64(_B_BITS)).astype(np.int32), (own & np.uint64((1 << _B_BITS) - 1)).astype(np.int32), np.diff(cut).astype(np.int32), np.full(len(own), self.base)]
                packed = [_binary(x[cut[0] : cut[-1]], cut - cut[0]) for x in (d, m)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *packed], names=_POSTING.names)


def _binary(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    offsets = (cut * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def _mapper(a_path: str, b_path: str, schema: T.StructType, columns: int):
    """(columns, text behind a space) to those columns and what is told of each document, and to rows of postings, where
    the other kind's columns are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = aligner(a_path, b_path)
        here = TaskContext.get().partitionId() << 40
        count, block = 0, None
        total, digest, sound = np.zeros(4, np.int64), hashlib.sha256(), True
        began = False  # whether the digest has something

        def posted(p: _Postings) -> Iterator[pa.RecordBatch]:
            for rows in p.rows():
                yield _wide(schema, dict(zip(rows.schema.names, rows.columns, strict=True)), rows.num_rows)

        for batch in (whole.slice(at, BLOCK_ROWS // 4) for whole in batches for at in range(0, whole.num_rows, BLOCK_ROWS // 4)):
            for row, data, offsets, goes_on in parcels(batch.column(columns), None, own.cut):
                per_row, place, segments = distinct(data, offsets, None, own.cut)
                values = own.memo(segments)
                bad = np.array([v is False for v in values], bool)
                fixed = [(b"", b"", (0, 0, 0)) if v is False else v for v in values]
                links = np.frombuffer(b"".join([v[0] for v in fixed]), _LINKED)
                size = np.array([len(v[0]) for v in fixed], np.int64) // 8
                numbers = np.array([v[2] for v in fixed], np.int64).reshape(-1, 3)
                texts = [v[1].decode() for v in fixed]
                row_of = np.repeat(np.arange(len(per_row)), per_row)
                # A text without bytes is the space alone: it has no tokens.
                spoilt = (np.bincount(row_of, weights=bad[place], minlength=len(per_row)) > 0) | ((np.diff(offsets) == 1) & (not began))
                stays = ~spoilt[row_of]
                sums = np.stack([np.bincount(row_of, weights=x, minlength=len(per_row)) for x in (*numbers[place].T, size[place])], axis=1).astype(np.int64) if len(place) else np.zeros((len(per_row), 4), np.int64)
                if block is None:
                    block = _Postings(here | count)
                used, docs = place[stays], row_of[stays]
                found = links[ragged((np.cumsum(size) - size)[used], size[used])]
                key = (found["a"].astype(np.uint64) << np.uint64(_B_BITS) | found["b"]) << np.uint64(16) | np.repeat(docs, size[used]).astype(np.uint64)
                key, times = np.unique(key, return_counts=True)
                doc = (key & np.uint64(0xFFFF)).astype(np.int64) + (here | count) - block.base
                block.add(key >> np.uint64(16), doc, times.astype(np.int64))
                cut = np.append(0, np.cumsum(per_row))
                if goes_on or began:
                    total += sums[0]
                    sound &= not spoilt[0]
                    if sound:
                        digest.update((";" if began else "").encode() + ";".join([texts[i] for i in place.tolist()]).encode())
                    began = True
                    if goes_on:
                        if block.size > 2 * ENTRIES:
                            block.compact()
                        continue
                    if not sound:
                        block.drop((here | count) - block.base)
                    told, hashes = total[None] * sound, [digest.hexdigest().encode() if sound else b""]
                else:
                    told = np.where(spoilt[:, None], 0, sums)
                    hashes = [b"" if s else hashlib.sha256(";".join([texts[i] for i in place[a:b].tolist()]).encode()).hexdigest().encode() for s, a, b in zip(spoilt.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                n = len(per_row)
                values = {"ref": pa.array((here | count) + np.arange(n)), "groups": pa.array(hashes, pa.binary())}
                values |= {c: pa.array(told[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                values |= {f"c{i}": batch.column(i).slice(row, n) for i in range(columns)}
                yield _wide(schema, values, n)
                count += n
                total, digest, sound, began = np.zeros(4, np.int64), hashlib.sha256(), True, False
                if block.size > ENTRIES or (here | count) - block.base > BLOCK_ROWS // 2:
                    yield from posted(block)
                    block = None
        if block is not None:
            yield from posted(block)

    return run


def _wide(schema: T.StructType, values: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    return pa.RecordBatch.from_arrays([values[f.name].cast(k) if f.name in values else pa.nulls(n, k) for f, k in zip(schema.fields, kinds, strict=True)], names=schema.names)


_STREAM = ["a", "part", "told", "b", "n", "base", "docs", "times"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, part, told, b, n, base, docs, times): of each (a, part) first counts by b, then postings. Gives
    (base, packed): of each block of documents the parts that its documents get, summed over what is held."""
    who = None
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    table: tuple[np.ndarray, np.ndarray, int] | None = None
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        base, doc, best, total = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((doc, base))
        base, doc, best, total = base[order], doc[order], best[order], total[order]
        first = np.flatnonzero(np.append(True, (base[1:] != base[:-1]) | (doc[1:] != doc[:-1])))
        x = np.empty(len(first), _PART)
        x["doc"], x["n_best"], x["count_sum"] = doc[first], np.add.reduceat(best, first), np.add.reduceat(total, first)
        base = base[first]
        cut = np.append(np.flatnonzero(np.append(True, base[1:] != base[:-1])), len(base))
        return pa.RecordBatch.from_arrays([pa.array(base[cut[:-1]]), _binary(x, cut)], names=["base", "packed"])

    for batch in batches:
        a, part, b, n = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
        told = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1]) | (told[1:] != told[:-1]))) if len(a) else []
        for begin, end in zip(new, [*new[1:], len(a)], strict=True):
            if not told[begin]:
                if who != (a[begin], part[begin]):
                    who, ids, counts, table = (a[begin], part[begin]), [], [], None
                ids.append(b[begin:end].copy())
                counts.append(n[begin:end].copy())
                continue
            if table is None:
                known = np.concatenate(counts)
                table = np.concatenate(ids), known, known.max()
            c = table[1][np.searchsorted(table[0], b[begin:end])]
            docs, times = batch.column(6).slice(begin, end - begin), batch.column(7).slice(begin, end - begin)
            entries = (_spans(docs) // 2).astype(np.int64)
            narrow = _spans(times) == entries
            base = np.repeat(batch.column(5).to_numpy()[begin:end], entries)
            if narrow.all():
                m = _values(times, np.uint8).astype(np.int64)
            else:
                m = np.concatenate([np.frombuffer(x, np.uint8 if k else np.int64).astype(np.int64) for x, k in zip(times.to_pylist(), narrow.tolist(), strict=True)])
            weight = np.repeat(c, entries)
            held.append((base, _values(docs, np.uint16), np.where(weight == table[2], m, 0), m * weight))
            size += len(base)
            if size >= 2 * ENTRIES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (base, packed) to (ref, n_best, count_sum) of each document."""
    who, sums, known = None, np.zeros((BLOCK_ROWS, 2), np.int64), np.zeros(BLOCK_ROWS, bool)

    def done() -> pa.RecordBatch:
        docs = np.flatnonzero(known)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (who + docs, sums[docs, 0].copy(), sums[docs, 1].copy())], names=["ref", "n_best", "count_sum"])

    for batch in batches:
        for base, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if base != who:
                if who is not None:
                    yield done()
                who = base
                sums[:], known[:] = 0, False
            x = np.frombuffer(packed.as_buffer(), _PART)
            sums[x["doc"], 0] += x["n_best"]
            sums[x["doc"], 1] += x["count_sum"]
            known[x["doc"]] = True
    if who is not None:
        yield done()


def _spans(column: pa.Array) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(at)


def _values(column: pa.Array, kind: type) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None, id_entries: int = ID_ENTRIES) -> DataFrame:
    """The columns `keep` of docs (None: doc_id) and, by row, n_a, n_b, n_groups, n_links, n_best, count_sum long and
    groups_sha256 string.

    Side A is a byte-level file of the tokenizers library and encodes a space and the text, side B a sentencepiece model
    that adds the space; strings of special tokens inside texts are plain text. n_links: pairs of token occurrences in one
    group; the count of a pair of ids: how many rows have it linked; count_sum: counts over all links; n_best: links
    whose count is the greatest that any pair with their A id has. groups_sha256: hex digest of all groups, `a1,a2|b1;...`.
    Rows whose text is null or empty, or whose tokens spell other bytes than the text's, have no tokens: zeros and ''.
    Repeated rows count each; an empty table gives no rows. Both files must be on every executor.
    """
    keep = keep if keep is not None else ["doc_id"]
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.concat(F.lit(" "), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema.fields[:-1]] + _TOLD.fields + _POSTING.fields)
    found = materialize(arrow_map(own, _mapper(a_path, b_path, schema, len(keep)), schema), "aligned")
    postings = found.where("a is not null").select(*_POSTING.names)
    counts = materialize(postings.groupBy("a", "b").agg(F.sum("n").alias("n")), "counts")
    # One row for each id of side A: no more than its vocabulary.
    dealt = counts.groupBy("a").agg(F.ceil(F.sum("n") / id_entries).cast("int").alias("parts"))
    tasks = F.broadcast(dealt)
    none = [F.lit(0).cast("long").alias("base"), *(F.lit(None).cast("binary").alias(c) for c in ("docs", "times"))]
    told = counts.join(tasks, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("told"), "b", "n", *none)
    spread = postings.join(tasks, "a").select("a", F.pmod(F.xxhash64("base"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("told"), "b", F.col("n").cast("long").alias("n"), "base", "docs", "times")
    n = max(found.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    streams = told.unionByName(spread).repartition(n, "a", "part").sortWithinPartitions("a", "part", "told", "b").select(*_STREAM)
    parts = arrow_map(streams, _stream, "base long, packed binary").repartition(n, "base").sortWithinPartitions("base")
    given = arrow_map(parts, _summed, "ref long, n_best long, count_sum long")
    each = found.where("ref is not null").select(*(f"c{i}" for i in range(len(keep))), *_TOLD.names)
    out = each.join(given, "ref", "left").select(
        *(f"c{i}" for i in range(len(keep))), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.decode("groups", "utf-8").alias("groups_sha256"),
    )
    return out.toDF(*keep, *out.columns[len(keep) :])
