"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and the first bytes of longer words, hashed, and once more if they come twice or more. The machine adds a weight for each term and, by
the inner product of two terms' vectors, one for each pair: an insult beside a group's name can count for more than both
alone. It is fitted on the driver on a bounded sample of labelled rows, of which only hashed terms get there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, by_place, chunks, prefix_sums, span_hash, spans_of, utf8

#: Hash space of each kind of terms.
TERMS = 1 << 20
#: Numbers of a word's first bytes that make terms of their own.
STEM_BYTES = (5, 6)
#: Words and stems, and the repeated ones.
KINDS = 2 * (1 + len(STEM_BYTES))
#: Labelled rows that are used for fitting; of more, those with the smallest hash of their id.
SAMPLE_ROWS = 16_000
#: Terms that get weights: the most telling ones of the sample.
FEATURES = 8192
FACTORS = 4
THRESHOLD = 0.7

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the distinct words and stems of a string array, in order; those that are repeated give a second term."""
    data, offsets = utf8(pc.utf8_lower(column))
    start, end = spans_of(_IS_WORD[data], offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    sums = prefix_sums(data)
    rows, found = [row], [span_hash(sums, start, end) % np.uint64(TERMS)]
    for kind, size in enumerate(STEM_BYTES, 1):
        long = end - start > size
        rows.append(row[long])
        found.append(span_hash(sums, start[long], start[long] + size) % np.uint64(TERMS) + np.uint64(kind * TERMS))
    pair, count = np.unique(np.concatenate(rows) * np.int64(KINDS * TERMS) + np.concatenate(found).astype(np.int64), return_counts=True)
    pair = np.sort(np.concatenate([pair, pair[count > 1] + (KINDS // 2) * TERMS]))
    return pair // (KINDS * TERMS), pair % (KINDS * TERMS)


@dataclass
class Machine:
    """places: feature of each term or -1. weights: of each feature, the last one the bias; vectors: (feature, factor)."""

    places: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities for `rows` rows with these distinct (row, feature) pairs."""
        total = self.weights[-1] + np.bincount(row, self.weights[feature], rows)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[feature, f]
            total += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def score_texts(self, column: pa.Array) -> np.ndarray:
        row, term = terms(column)
        feature = self.places[term].astype(np.int64)
        known = feature >= 0
        return self.scores(row[known], feature[known], len(column))


def gradient(w: np.ndarray, v: np.ndarray, row: np.ndarray, feature: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean logistic loss of rows with these distinct (row, feature) pairs, by weights (the last one the bias) and
    vectors."""
    n, m, factors = len(labels), len(w) - 1, v.shape[1]
    vf = v[feature]
    sums = np.stack([np.bincount(row, vf[:, k], n) for k in range(factors)], 1)
    squares = np.bincount(row, (vf * vf).sum(1), n)
    total = w[m] + np.bincount(row, w[feature], n) + 0.5 * ((sums * sums).sum(1) - squares)
    error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels) / n
    dw = np.bincount(feature, error[row], m + 1)
    dw[m] = error.sum()
    return dw, np.stack([np.bincount(feature, error[row] * (sums[row, k] - vf[:, k]), m + 1) for k in range(factors)], 1)


def fit(bags: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = 40, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over mini-batches, soft thresholds on weights and shrinkage of vectors.

    bags: the distinct terms of each row. Without rows, every score is a half.
    """
    n, positive = len(bags), float(labels.sum())
    places = np.full(KINDS * TERMS, -1, np.int16)
    if not n:
        return Machine(places, np.zeros(1), np.zeros((1, factors)))
    rate = (positive + 1) / (n + 2)
    seen, told = np.zeros(KINDS * TERMS, np.int32), np.zeros(KINDS * TERMS, np.int32)
    for at in range(0, n, 500):
        for counts, some in ((seen, bags[at : at + 500]), (told, [b for b, y in zip(bags[at : at + 500], labels[at : at + 500], strict=True) if y])):
            if some:
                term, times = np.unique(np.concatenate(some), return_counts=True)
                counts[term] += times.astype(np.int32)
    candidates = np.flatnonzero(seen >= 4)
    often = seen[candidates]
    z = (told[candidates] - often * rate) / np.sqrt(often * rate * (1 - rate))
    best = np.argsort(-np.abs(z), kind="stable")[:features]
    chosen = np.sort(candidates[best[np.abs(z[best]) >= 3]])
    places[chosen] = np.arange(len(chosen), dtype=np.int16)
    known = [places[b] for b in bags]
    known = [k[k >= 0].astype(np.int64) for k in known]
    row, feature = np.repeat(np.arange(n), [len(k) for k in known]), np.concatenate(known)
    m = len(chosen)
    random = np.random.default_rng(seed)
    w, v = np.zeros(m + 1), random.normal(0, 0.05, (m + 1, factors))
    w[m] = np.log(rate / (1 - rate))
    v[m] = 0
    gw, gv = np.full(m + 1, 1e-2), np.full((m + 1, factors), 1e-2)
    first = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, 500):
            own = np.sort(order[at : at + 500])
            count = first[own + 1] - first[own]
            r = np.repeat(np.arange(len(own)), count)
            f = feature[np.repeat(first[own], count) + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)]
            dw, dv = gradient(w, v, r, f, labels[own])
            gw += dw * dw
            gv += dv * dv
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.1 * (dv + 1e-4 * v) / np.sqrt(gv)
            w[:m] = np.sign(w[:m]) * np.maximum(np.abs(w[:m]) - 1e-5 / np.sqrt(gw[:m]), 0)
    v[m] = 0
    return Machine(places, w, v)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashed terms and labels of at most `rows` labelled rows, those with the smallest hash of their id; rows equal in
    id and text count once. The sample of ids is broadcast; texts stay put, and no more than `rows` rows leave them."""
    own = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_k").agg(F.max("_y").alias("_y"))
    own = own.orderBy(F.xxhash64("_k"), "_k").limit(rows)
    joined = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(own), F.col("_key") == F.col("_k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                row, term = terms(batch.column(1).slice(a, b - a))
                cut, term = np.searchsorted(row, np.arange(b - a + 1)), term.astype("<u4")
                bags = [term[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(bags, pa.binary())], ["k", "y", "bag"])

    key_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField("k", key_type), T.StructField("y", T.IntegerType()), T.StructField("bag", T.BinaryType())])
    bags = arrow_map(joined.select("_key", "_text", "_y"), run, schema)
    if joined.count() > rows:
        bags = bags.dropDuplicates(["k", "bag"]).orderBy(F.xxhash64("k"), "k", "bag").limit(rows)
    got = sorted({(r["k"], r["bag"]): r["y"] for r in bags.toLocalIterator()}.items())
    return [np.frombuffer(bag, "<u4") for (_, bag), _ in got], np.array([y for _, y in got], float)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most `rows` labelled documents. Of several labels of a document the largest holds; null labels,
    and labels of no document, are left out."""
    return fit(*sample(docs, labels, key, text, label, rows))


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (None: all) and _score double, in place of a column of that name, from the text alone; a
    null text counts as empty.

    A map without a shuffle; repeated rows keep their number.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in keep or docs.columns if c != "_score"]
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            parts = [held.value.score_texts(texts.slice(a, b - a)) for a, b in chunks(texts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores)], names=schema.names)

    return arrow_map(own, run, schema).toDF(*kept, "_score")


def reject(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of which the score is below the threshold, all their columns."""
    scored = score(by_place(docs), machine, f"c{docs.columns.index(text)}")
    return scored.where(F.col("_score") < threshold).drop("_score").toDF(*docs.columns)
