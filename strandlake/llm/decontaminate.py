"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of every WINDOW consecutive words the smallest hash of its K-word grams is its
fingerprint, so a shared window always shares a fingerprint. The documents' fingerprints are joined with the
benchmark's; at a match the windows around it are looked up among the item windows and compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, by_place, chunks, mix, prefix_sums, span_hash, spans_of, utf8

WINDOW = 10
K = 5
#: Bytes of benchmark text whose index goes to the executors at once; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of several texts: lower-cased bytes, where words lie, their texts and hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = utf8(column)
        data = _LOWER[data]
        start, end = spans_of(_IS_WORD[data], offsets)
        text = np.searchsorted(offsets, start, side="right") - 1
        return cls(data, start, end, text, span_hash(prefix_sums(data), start, end))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k words from each word on; those that would leave the text are included and not valid."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _STEP + self.hash[j : j + n]
        return mix(out)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one text."""
        n = len(self.text) - k + 1
        return self.text[:n] == self.text[k - 1 :] if n > 0 else np.zeros(0, bool)

    def joined(self, i: int, k: int) -> bytes:
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[i : i + k], self.end[i : i + k], strict=True))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, the place of the smallest one (of equal ones the last)."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        later = grams[j : j + n]
        less = later <= best
        best = np.where(less, later, best)
        at = np.where(less, np.arange(j, j + n), at)
    return at


def found(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


@dataclass
class Index:
    """The windows of a block of items. shapes: for each window length its gram length, fingerprints and windows."""

    shapes: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    content: list[bytes]
    items: list[list[int]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], window: int, k: int) -> Index:
        words = Words.of(pa.array(texts, pa.string()))
        counts = np.bincount(words.text, minlength=len(texts))
        first = (np.cumsum(counts) - counts).astype(np.int64)
        known: dict[bytes, int] = {}
        content: list[bytes] = []
        items: list[list[int]] = []
        places: dict[int, list[tuple[int, int]]] = {}
        for item, (n, at) in enumerate(zip(counts.tolist(), first.tolist(), strict=True)):
            size = min(n, window)
            for i in range(at, at + n - size + 1) if n else ():
                b = words.joined(i, size)
                w = known.setdefault(b, len(content))
                if w == len(content):
                    content.append(b)
                    items.append([])
                    places.setdefault(size, []).append((i, w))
                if not items[w] or items[w][-1] != item:
                    items[w].append(item)
        shapes = {}
        for size, pairs in places.items():
            at, which = np.array(pairs, np.int64).T
            gram = k if size == window else size
            prints = words.grams(gram)[winnow(words.grams(gram), size - gram + 1)[at]]
            hashes = words.grams(size)[at]
            order = np.argsort(hashes, kind="stable")
            shapes[size] = (gram, np.unique(prints), hashes[order], which[order])
        return cls(shapes, content, [[ids[i] for i in x if ids[i] is not None] for x in items])

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, number of words, window) of all occurrences in the texts."""
        for size, (gram, prints, hashes, which) in self.shapes.items():
            grams = words.grams(gram)
            at = winnow(grams, size - gram + 1)
            chosen = np.unique(at)
            good = np.zeros(len(grams), bool)
            good[chosen] = found(prints, grams[chosen])
            near = np.flatnonzero(good[at] & words.inside(size)) if len(at) else at
            if not len(near):
                continue
            own = words.grams(size)[near]
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
            for i, a, b in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                content = words.joined(i, size)
                for w in which[a:b].tolist():
                    if self.content[w] == content:
                        yield i, size, w


def _scan(column: pa.Array, index: Index, before: list | None) -> Iterator[tuple[int, list[dict], list[int]]]:
    for a, b in chunks(column):
        words = Words.of(column.slice(a, b - a))
        n = b - a
        counts = np.bincount(words.text, minlength=n)
        first = (np.cumsum(counts) - counts).astype(np.int64)
        cover = np.zeros(len(words.start) + 1, np.int64)
        names: dict[int, set] = {}
        for i, size, w in index.hits(words):
            cover[i] += 1
            cover[i + size] -= 1
            names.setdefault(int(words.text[i]), set()).update(index.items[w])
        for row, (spans, old) in enumerate(before[a:b] if before else ()):
            for s in spans:
                cover[first[row] + s["start"]] += 1
                cover[first[row] + s["end"]] -= 1
            if old:
                names.setdefault(row, set()).update(old)
        hit = np.cumsum(cover)[:-1] > 0
        start, end = spans_of(hit, np.concatenate([first, [len(hit)]]))
        of = words.text[start] if len(start) else start
        spans: dict[int, list[dict]] = {}
        for t, s, e in zip(of.tolist(), start.tolist(), end.tolist(), strict=True):
            spans.setdefault(t, []).append({"start": s - int(first[t]), "end": e - int(first[t])})
        for row in range(n):
            yield int(counts[row]), spans.get(row, []), sorted(names.get(row, ()))


def _pass(df: DataFrame, text: str, index: Index, item_type: T.DataType, keep: list[str]) -> DataFrame:
    """One block: adds to the hit spans and items that earlier blocks have left in the rows; keep: columns to pass on."""
    held = df.sparkSession.sparkContext.broadcast(index)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    names = ["_n_words", "_hit_spans", "_item_ids"]
    kept = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*kept, T.StructField(names[0], T.LongType()), T.StructField(names[1], spans), T.StructField(names[2], T.ArrayType(item_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            before = list(zip(column["_hit_spans"].to_pylist(), column["_item_ids"].to_pylist(), strict=True)) if "_hit_spans" in column else None
            rows = list(_scan(column[text], held.value, before))
            found = [pa.array([r[i] for r in rows], out.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(column[f.name] for f in kept), *found], names=out.names)

    return arrow_map(df, run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    k: int = K,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of docs (None: all) and `_n_words` long, `_hit_spans` array of word ranges, `_item_ids` array, in
    place of columns of these names.

    The benchmark's size is measured first. Blocks of at most about block_bytes are indexed on the driver and
    broadcast, one pass over the rows each, chained without a shuffle; one item is never split. A null or empty text
    has no words and no hits; null items have no windows; items without an id hit but are not named; items that are
    equal are all named. Without items nothing is hit. Repeated documents give repeated rows.
    """
    items = benchmark.select(F.col(item).alias("_id"), F.col(item_text).alias("_t")).where("_t is not null")
    total = items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    item_type = benchmark.schema[item].dataType
    added = ["_n_words", "_hit_spans", "_item_ids"]
    names = [c for c in keep or docs.columns if c not in added]
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(f"`{text}`").alias("text"))
    kept = out.columns[:-1]
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == block).orderBy("_id", "_t").collect()
        index = Index.of([r[0] for r in rows], [r[1] for r in rows], window, k)
        out = _pass(out, "text", index, item_type, kept if block == blocks - 1 else [*kept, "text"])
    return out.toDF(*names, *added)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs of which no word is in an occurrence of a benchmark window, with their columns."""
    own = by_place(docs)
    hit = decontaminate(own, benchmark, f"c{docs.columns.index(text)}")
    return hit.where(F.size("_hit_spans") == 0).select(*own.columns).toDF(*docs.columns)
