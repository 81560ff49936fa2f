"""Removal of repeated byte strings by longest previous factors, distributed by content.

A string of LENGTH bytes is repeated if it also starts earlier, that is, if the longest previous factor at its start has
LENGTH bytes at least. Every window of LENGTH bytes is filed under its anchor, the GRAM bytes in it that have the smallest
hash: equal windows have equal anchors at equal places. Neighbouring windows of one anchor make a segment. Anchors that
occur once are done with. Of segments with equal content (anchor and 128 bits of xxHash) all but the first are repeated
whole. What is left, the different segments around equal anchors, is sorted by its bytes: from suffix order and the
common prefixes of neighbours the previous and the next smaller position give the longest previous factor of each window.

An anchor around which a sample of documents has CROWDED different segments or more, such as an edge of a passage that a
large share of all documents has, would put too much in one task. Its windows are filed one by one under their own
content instead. The sample only decides where windows meet: equal windows meet either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, blocks, chunks, grouped, integer_key, materialize, prefix_sums, span_hash

LENGTH = 100
GRAM = 32
#: Segments that a map task gathers before it hands them on, and that a bucket's task holds before it drops copies.
FLUSH, HELD = 1 << 17, 1 << 20
#: Bytes of text that a kernel takes at once, and bytes of segments that are sorted together (or one anchor's).
BLOCK_BYTES, SORT_BYTES = 1 << 17, 1 << 20
#: Different segments around one anchor, in a sample of one document in SAMPLE_EACH but within SAMPLE_ROWS, from which on
#: its windows are filed one by one.
CROWDED, SAMPLE_EACH, SAMPLE_ROWS = 32, 64, (1 << 14, 1 << 20)
#: Buckets of anchors for each partition of the input, and their greatest number.
BUCKETS_EACH, MOST_BUCKETS = 8, 1 << 24

_SEGMENT = np.dtype([("h", "u8"), ("s", "u8"), ("r", "u8"), ("doc", "i8"), ("t", "i8"), ("lo", "i4"), ("n", "u1")])
_SPAN = np.dtype([("doc", "i8"), ("t", "i8"), ("lo", "i4"), ("hi", "i4")])
_FOUND = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("t", T.LongType()), T.StructField("h", T.LongType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor hash) of each segment; windows are places in data, at most 2**20 of them."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(len(data) - gram + 1)
    value = span_hash(prefix_sums(data), at, at + gram)
    least = (value & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
    have, width = 1, length - gram + 1
    while have < width:  # least[i]: smallest hash, and its place, of `have` grams from i on
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    window = np.flatnonzero(ends - np.arange(n) >= length)
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    place = (least[window] & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(_runs(place, ends[window]))
    last = np.append(first[1:], len(window)) - 1
    return np.searchsorted(offsets, window[first], side="right") - 1, window[first], window[last], value[place[first]]


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each span, as two columns."""
    raw, digest = memoryview(data.tobytes()), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def _segments(batch: pa.RecordBatch, length: int, gram: int, crowded: np.ndarray) -> Iterator[np.ndarray]:
    """Segments of (doc, t, text) rows; those of crowded anchors as single windows under their own content."""
    docs, ts = (batch.column(i).to_numpy() for i in (0, 1))
    for row, data, offsets, base in blocks(batch.column(2), BLOCK_BYTES, length - 1):
        own, lo, hi, h = anchors(data, offsets, length, gram)
        if not len(own):
            continue
        if len(crowded):
            many = crowded[np.minimum(np.searchsorted(crowded, h), len(crowded) - 1)] == h
            count = np.where(many, hi - lo + 1, 1)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            own, many, h = (np.repeat(x, count) for x in (own, many, h))
            lo, hi = np.repeat(lo, count) + inside, np.where(many, np.repeat(lo, count) + inside, np.repeat(hi, count))
        out = np.empty(len(own), _SEGMENT)
        out["s"], out["r"] = _digests(data, lo, hi + length).T
        out["h"] = np.where(many, out["s"], h) if len(crowded) else h
        out["doc"], out["t"] = docs[row + own], ts[row + own]
        out["lo"], out["n"] = base + lo - offsets[own], hi - lo + 1
        yield out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, later copies) of segments by content, ordered; one that lies where its first lies, as in a repeated row,
    is neither."""
    x = x[np.lexsort((x["lo"], x["t"], x["doc"], x["r"], x["s"], x["h"]))]
    first = _runs(x["h"], x["s"], x["r"])
    own = x[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))]
    same = (x["doc"] == own["doc"]) & (x["t"] == own["t"]) & (x["lo"] == own["lo"])
    return x[first], x[~same]


def _merged(doc: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the spans of each document."""
    if not len(doc):
        return doc, t, start, end
    order = np.lexsort((end, start, t, doc))
    doc, t, start, end = doc[order], t[order], start[order].astype(np.int64), end[order].astype(np.int64)
    own = np.cumsum(_runs(doc, t)) << 32
    reach = np.maximum.accumulate(own + end)
    new = np.ones(len(doc), bool)
    new[1:] = own[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], t[first], start[first], reach[last] - own[last]


def _planes(x: np.ndarray) -> bytes:
    """Rows with the bytes of each place side by side, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(packed: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _cells(x: np.ndarray, key: np.ndarray, told: bool) -> list[tuple[int, bool, bytes]]:
    if not len(x):
        return []
    order = np.argsort(key, kind="stable")
    x, key = x[order], key[order]
    cut = np.flatnonzero(_runs(key))
    return [(k, told, _planes(part)) for k, part in zip(key[cut].tolist(), np.split(x, cut[1:]), strict=True)]


def _map_side(length: int, gram: int, buckets: int, held):
    """Arrow batches (doc, t, text) to (bucket, told, packed): segments by anchor, and spans that are settled already.
    held: a broadcast of the sorted crowded anchors."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, copies = _split(np.concatenate(parts))
        doc, t, start, end = _merged(copies["doc"], copies["t"], copies["lo"], copies["lo"].astype(np.int64) + copies["n"] + (length - 1))
        spans = np.empty(len(doc), _SPAN)
        spans["doc"], spans["t"], spans["lo"], spans["hi"] = doc, t, start, end
        rows = _cells(spans, np.abs(doc % buckets), True) + _cells(x, ((x["h"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), False)
        for at in range(0, len(rows), 64):
            k, told, packed = zip(*rows[at : at + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(told), pa.array(packed, pa.binary())], ["bucket", "told", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for x in _segments(batch, length, gram, held.value):
                parts.append(x)
                size += len(x)
                if size >= FLUSH:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


def _contents(length: int, gram: int):
    """Arrow batches (doc, t, text) to the different (h, s) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _segments(batch, length, gram, np.zeros(0, np.uint64)):
                pairs = np.unique(x[["h", "s"]])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[c]).view(np.int64)) for c in ("h", "s")], ["h", "s"])

    return run


def _crowded(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """The sorted anchors around which the sample has CROWDED different segments; their number is bounded by the sample's."""
    rows = texts.count()
    wanted = min(max(rows // SAMPLE_EACH, SAMPLE_ROWS[0]), SAMPLE_ROWS[1])
    share = min(1.0, wanted / max(1, rows))
    some = texts.where(F.pmod(F.xxhash64("_doc", "_t", F.lit("sample")), F.lit(1 << 20)) < round(share * (1 << 20)))
    pairs = arrow_map(some, _contents(length, gram), "h long, s long").distinct()
    found = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWDED).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _rows(doc: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 1 << 15):
        part = slice(at, at + (1 << 15))
        hs = pa.nulls(len(doc[part]), pa.int64()) if h is None else pa.array(np.ascontiguousarray(h[part]).view(np.int64))
        long = [pa.array(np.ascontiguousarray(c[part])) for c in (doc, t)]
        places = [pa.array(c[part].astype(np.int32)) for c in (start, end)]
        yield pa.RecordBatch.from_arrays([*long, hs, *places], names=_FOUND.names)


def _meet(length: int):
    """Buckets of segments to found rows: with a null h a repeated span, else a segment whose bytes are to be compared."""

    def copied(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _rows(x["doc"], x["t"], x["lo"], x["lo"] + x["n"] + (length - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            x, copies = _split(np.concatenate(parts))
            yield from copied(copies)
            new = _runs(x["h"]) if len(x) else np.zeros(0, bool)
            alone = new & np.append(new[1:], True)
            x = x[~alone]
            yield from _rows(x["doc"], x["t"], x["lo"], x["lo"] + x["n"] + (length - 1), x["h"])

        for batch in batches:
            for k, told, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != bucket:
                    yield from done()
                    bucket, parts, size = k, [], 0
                raw = packed.as_buffer()
                if told:
                    x = _from_planes(raw, _SPAN)
                    yield from _rows(x["doc"], x["t"], x["lo"], x["hi"])
                    continue
                parts.append(_from_planes(raw, _SEGMENT))
                size += len(parts[-1])
                if size >= HELD:
                    x, copies = _split(np.concatenate(parts))
                    yield from copied(copies)
                    parts, size = [x], 0
        yield from done()

    return run


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the longest match with an earlier one, from the suffix array and the lcp of neighbours in it.

    lcp[i] belongs to order[i - 1] and order[i]. The nearest suffixes before and after that start at a smaller position
    are the two candidates. They are found for all at once: a suffix whose candidate starts later goes on to that one's
    own candidate, with the least common prefix on the way.
    """

    def before(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        to, match = np.arange(len(order)) - 1, lcp.copy()
        open_ = np.flatnonzero(to >= 0)
        while len(open_ := open_[order[to[open_]] > order[open_]]):
            via = to[open_]
            match[open_], to[open_] = np.minimum(match[open_], match[via]), to[via]
            open_ = open_[to[open_] >= 0]
        return np.where(to >= 0, match, 0)

    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before(order, lcp), before(order[::-1], np.append(lcp[:1], lcp[:0:-1]))[::-1])
    return out


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the rows of a byte matrix, prefixes of suffixes, sorted, and the common prefixes of neighbours."""
    n, length = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 14):
        part = order[at - 1 : at + (1 << 14)]
        differ = windows[part[1:]] != windows[part[:-1]]
        lcp[at : at + len(part) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, lcp


def repeated_windows(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which rows of the byte matrix have a longest previous factor of their whole length; position numbers the rows."""
    if not len(windows):
        return np.zeros(0, bool)
    order, lcp = suffix_order(windows)
    return longest_previous_factors(position[order], lcp)[position] >= windows.shape[1]


def _compare(length: int):
    """Sorted rows (bucket, h, doc, t, start, bytes) to repeated spans, whole anchors at a time."""

    def spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(doc, t, start): raw for _, doc, t, start, raw in rows}.items())
        doc, t, start = np.array([k for k, _ in rows], np.int64).T
        size = np.array([len(raw) for _, raw in rows], np.int64)
        data = np.frombuffer(b"".join(raw for _, raw in rows), np.uint8)
        count = size - length + 1
        segment = np.repeat(np.arange(len(rows)), count)
        inside = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        windows = np.lib.stride_tricks.sliding_window_view(data, length)[np.repeat(np.cumsum(size) - size, count) + inside]
        hit = repeated_windows(windows, np.arange(len(segment)))
        begin = (start[segment] + inside)[hit]
        yield from _rows(*_merged(doc[segment][hit], t[segment][hit], begin, begin + length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in grouped(batch.select([1, 2, 3, 4, 5]) for batch in batches):
            if held and size + sum(len(r[4]) for r in rows) > SORT_BYTES:
                yield from spans(held)
                held, size = [], 0
            held += rows
            size += sum(len(r[4]) for r in rows)
        if held:
            yield from spans(held)

    return run


def _slices(columns: int, buckets: int):
    """(own columns, asked segments) to (bucket, h, doc, t, start, bytes); repeated rows answer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            docs, ts = (batch.column(i).to_pylist() for i in (0, 1))
            texts, asks = batch.column(2).cast(pa.binary()), batch.column(columns)
            for i, who in enumerate(zip(docs, ts, strict=True)):
                if who == before:
                    continue
                before = who
                text = texts[i].as_buffer()
                h, start, end = (asks[i].values.field(k).to_numpy() for k in range(3))
                for at in range(0, len(h), 1 << 12):
                    part = slice(at, at + (1 << 12))
                    raw = [text[a:b].to_pybytes() for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                    n = len(raw)
                    bucket = ((h[part].view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                    who_columns = [pa.array(np.full(n, x, np.int64)) for x in who]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h[part]), *who_columns, pa.array(start[part]), pa.array(raw, pa.binary())], ["bucket", "h", "doc", "t", "start", "bytes"])

    return run


def _cut(schema: T.StructType, columns: int, whole_chars: bool):
    """(doc, t, text, columns, found spans) to the columns with kept bytes and merged spans."""

    def piece(raw: bytes) -> bytes:
        return raw.decode("utf-8", "ignore").encode() if whole_chars else raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for a, b in chunks(whole.column(2)):
                batch = whole.slice(a, b - a)
                kept, spans = [], []
                for text, found in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(columns).to_pylist(), strict=True):
                    parts, at, own = [], 0, []
                    for s, e in sorted((f["start"], f["end"]) for f in found or ()):
                        if own and s <= own[-1]["end"]:
                            own[-1]["end"] = max(own[-1]["end"], e)
                        else:
                            own.append({"start": s, "end": e})
                    for f in own:
                        parts.append(piece(text[at : f["start"]]))
                        at = f["end"]
                    kept.append(b"".join([*parts, piece(text[at:])]))
                    spans.append(own)
                yield pa.RecordBatch.from_arrays([*batch.columns[3:columns], pa.array(kept, pa.binary()), pa.array(spans, span_type)], names=schema.names)

    return run


def _identity(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """What tells documents apart, in their order: the key, a null as the smallest, and where any key is shared a hash of
    the text; else 0, as an expression of the key, so that joins and groups on both share a partitioning."""
    own = integer_key(docs, key)
    shared = docs.groupBy(own.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own, own.bitwiseAND(F.lit(0).cast("long")) if shared.isEmpty() else F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _kept_and_spans(docs: DataFrame, key: str, text: str, keep: list[str], length: int, gram: int, whole_chars: bool) -> DataFrame:
    """Columns c0, c1, ... (those of keep), kept binary, spans."""
    spark = docs.sparkSession
    doc, t = _identity(docs, key, text)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(doc.alias("_doc"), t.alias("_t"), raw.alias("_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    partitions = max(own.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(MOST_BUCKETS, BUCKETS_EACH * partitions)
    texts = own.select("_doc", "_t", "_text")
    held = spark.sparkContext.broadcast(_crowded(texts, length, gram))
    packed = arrow_map(texts, _map_side(length, gram, buckets, held), "bucket long, told boolean, packed binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(arrow_map(met, _meet(length), _FOUND), "found")

    def beside(rows: DataFrame, what: Column, how: str) -> DataFrame:
        """The texts with what was found for them; both times whole rows, so that one shuffle of the texts serves twice."""
        lists = rows.groupBy("doc", "t").agg(F.collect_list(what).alias("_list"))
        return own.join(lists, (F.col("_doc") == F.col("doc")) & (F.col("_t") == F.col("t")), how).select(*own.columns, "_list")

    asked = beside(found.where("h is not null"), F.struct("h", "start", "end"), "inner")
    some = arrow_map(asked, _slices(len(own.columns), buckets), "bucket long, h long, doc long, t long, start int, bytes binary")
    late = arrow_map(some.repartition("bucket").sortWithinPartitions("bucket", "h"), _compare(length), _FOUND)
    repeated = found.where("h is null").unionByName(late).select("doc", "t", "start", "end")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*own.schema.fields[3:], T.StructField("kept", T.BinaryType()), T.StructField("spans", span)])
    return arrow_map(beside(repeated, F.struct("start", "end"), "left"), _cut(schema, len(own.columns), whole_chars), schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, whole_chars: bool = False) -> DataFrame:
    """The columns `keep` of docs (None: all but the text) with _kept binary and _spans, the removed byte ranges; columns of
    docs with these two names are replaced. whole_chars: what a range leaves of a character is not kept either, so _kept
    is text.

    Texts are UTF-8 bytes, nulls empty; matches never cross documents, which are in the order of the integer key (null
    first) and, of equal keys, of a hash of the text. Rows equal in key and text are one document: they are judged
    alike and not against each other. Texts shorter than `length` bytes stay.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if (keep is not None or c != text) and c not in ("_kept", "_spans")]
    return _kept_and_spans(docs, key, text, kept, length, gram, whole_chars).toDF(*kept, "_kept", "_spans")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs, all columns, with the repeated strings cut out of the text, and with them what they leave of a character.
    A null text becomes empty; a document of which nothing is left stays."""
    out = _kept_and_spans(docs, key, text, docs.columns, length, gram, True)
    place = docs.columns.index(text)
    return out.withColumn(f"c{place}", F.decode("kept", "utf-8")).drop("kept", "spans").toDF(*docs.columns)
