"""Importance resampling of raw text towards target text.

Two generative models of hashed n-grams, one of the target and one of the raw texts, give each document a log weight,
the log ratio of its probabilities. Adding Gumbel noise and keeping the k largest sums draws k documents without
replacement, in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, chunks, materialize, mix, prefix_sums, span_hash, spans_of, utf8

#: Buckets of hashed n-grams (n up to 2) of each model for texts of up to BUCKET_BYTES in all. Of more text there are
#: more, with the square root of its bytes, about as the number of different words grows: 2**19 for 30 GB.
BUCKETS, BUCKET_BYTES = 1 << 14, 1 << 25
#: Size of the target's ids, as measured, up to which they are broadcast; beyond, texts and ids are shuffled by key.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch of counts.
COUNT_ROWS = 1 << 16
#: Equal parts into which the range of keys is cut when the k-th largest is looked for, and rows that end the search.
BINS, FEW = 1024, 20_000

_CLASS = np.full(256, 1, np.uint8)  # 0 white space, 1 punctuation, 2 of a word
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 2


def buckets_for(n_bytes: int) -> int:
    """Buckets of each model for so many bytes of text: a power of two."""
    return BUCKETS << max(0, math.ceil(math.log2(max(1, n_bytes) / BUCKET_BYTES) / 2))


def ngrams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all words, runs of punctuation and pairs of neighbours among them, lower-cased."""
    data, offsets = utf8(pc.utf8_lower(column))
    kind = _CLASS[data]
    spans = [spans_of(kind == k, offsets) for k in (1, 2)]
    start, end = (np.concatenate([s[i] for s in spans]) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    row = np.searchsorted(offsets, start, side="right") - 1
    one = span_hash(prefix_sums(data), start, end)
    two = mix(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:])
    same = row[1:] == row[:-1]
    bucket = np.concatenate([one, two[same]]) % np.uint64(buckets)
    return np.concatenate([row, row[:-1][same]]), bucket.astype(np.int64)


def counts(docs: DataFrame, text: str, member: str, buckets: int) -> DataFrame:
    """(bucket, raw, target): how often each bucket that occurs does so in all texts and in those where `member` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in chunks(batch.column(0)):
                row, bucket = ngrams(batch.column(0).slice(a, b - a), buckets)
                for n, part in zip(total, (bucket, bucket[chosen[a:b][row]]), strict=True):
                    each, times = np.unique(part, return_counts=True)
                    n[each] += times
        seen = np.flatnonzero(total[0])
        for at in range(0, len(seen), COUNT_ROWS):
            part = seen[at : at + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0][part]), pa.array(total[1][part])], ["bucket", "raw", "target"])

    parts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), F.coalesce(F.col(member), F.lit(False)).alias("_in"))
    parts = arrow_map(parts, run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counted: DataFrame, buckets: int) -> np.ndarray:
    """log(target / raw) of each bucket, both models smoothed by one occurrence of every bucket."""
    bucket, *found = (c.to_numpy() for c in counted.select("bucket", "raw", "target").toArrow().columns)
    raw, target = np.ones((2, buckets))
    raw[bucket] += found[0]
    target[bucket] += found[1]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, log_weight double, n_grams long); a text without n-grams has weight 0."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([docs.schema[key], T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                row, bucket = ngrams(batch.column(1).slice(a, b - a), len(held.value))
                sums = np.bincount(row, held.value[bucket], b - a).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sums), pa.array(np.bincount(row, minlength=b - a).astype(np.int64))], names=schema.names)

    return arrow_map(docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")), run, schema)


def largest(rows: DataFrame, k: int, by: str, ties: str) -> DataFrame:
    """The k rows with the largest `by` (of equal ones those with the smaller `ties`), found by histograms: no task
    sorts more than FEW rows. More than FEW rows with one and the same `by` are copies of a row: any of them are taken."""
    low, high, n = rows.agg(F.min(by), F.max(by), F.count(by)).first()
    if n <= k or low is None:
        return rows
    sure, rest = None, k
    inside = F.lit(True)
    while True:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(by) - low) / width), F.lit(BINS - 1).cast("long")) if width > 0 else F.lit(0)
        seen = {r[0]: r[1:] for r in rows.where(inside).groupBy(place.alias("p")).agg(F.count(F.lit(1)), F.min(by), F.max(by)).collect()}
        for p in sorted(seen, reverse=True):
            count, least, most = seen[p]
            if count > rest:
                break
            rest -= count
            sure = least
        else:
            break
        low, high = least, most
        inside = F.col(by).between(low, high)
        if rest == 0 or count <= FEW or low == high:
            break
    above = rows.where(F.col(by) >= sure) if sure is not None else rows.limit(0)
    if rest == 0:
        return above
    part = rows.where(inside & (F.col(by) < sure) if sure is not None else inside)
    return above.unionByName((part if count > FEW else part.orderBy(F.desc(by), ties)).limit(rest))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", target_rows: int | None = None, share: float | None = None, seed: int = 17) -> DataFrame:
    """(key, log_weight, gumbel_key) of the documents drawn.

    Target: labelled documents whose largest label is 1 (of more than target_rows ids, where that is given, those with
    the smallest hash); raw: all documents. share of the
    documents are drawn; None: as large a share as the labelled documents' with label 1. A null or empty text weighs 1
    (log 0). The noise comes from a hash of key and seed, so copies under one key are drawn together or by order of the
    key. No labels draw nothing, unless a share is given.
    """
    own = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_k").agg(F.max("_y").alias("_y"))
    size = F.sum(F.when(F.col("_y") == 1, 16 + F.octet_length(F.col("_k").cast("string"))))
    labelled, good, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0)), F.coalesce(size, F.lit(0))).first()
    ids = own.where("_y = 1").select("_k", F.lit(True).alias("_in"))
    if target_rows is not None and target_rows < good:
        ids = ids.orderBy(F.xxhash64("_k"), "_k").limit(target_rows)
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_t"))
    buckets = buckets_for(texts.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0])
    joined = texts.join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, F.col("_key") == F.col("_k"), "left")
    ratios = log_ratios(counts(joined, "_t", "_in", buckets), buckets)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    weighed = materialize(weigh(docs, ratios, key, text).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weighed")
    k = round((share if share is not None else good / max(1, labelled)) * weighed.count())
    return largest(weighed, k, "gumbel_key", key).select(key, "log_weight", "gumbel_key")
