"""SimHash fingerprints and their neighbours by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, by_place, chunks, grouped, integer_key, materialize, utf8
from strandlake.operators.graph import components

WORDS = 4
SEED = 42
MAX_BITS = 4
#: Numbers of different fingerprints up to which they are cut into so many segments. All of them find the same pairs; of
#: more fingerprints, wider segments hold fewer each, and their balls are larger.
SEGMENTS = ((1 << 24, 3), (1 << 62, 2))


def shingles(text: bytes, words: int) -> list[bytes]:
    """Every run of `words` words, lower-cased (A-Z) and joined by spaces; of fewer words, all of them; of none, none."""
    found = text.lower().split()
    n = len(found) - words + 1
    joined = b" ".join(found)
    if n <= 1:
        return [joined] if found else []
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    return [joined[s:e] for s, e in zip((end - size)[:n].tolist(), end[words - 1 :].tolist(), strict=True)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes, rows of bytes, have each bit set, highest bit first."""
    total = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        total += np.unpackbits(hashes[at : at + (1 << 13)], axis=1).sum(axis=0, dtype=np.uint32)
    return total


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if set in over half the hashes; without words 0."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in shingles(text, words)], ">u8").view(np.uint8).reshape(-1, 8)
    return int.from_bytes(np.packbits(bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(key, fp long) of whole texts; a null or empty text has fingerprint 0."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                prints = [simhash(x, words, seed) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], [key, "fp"])

    return arrow_map(df.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")), run, schema)


def segment_radii(max_bits: int, segments: int) -> list[int]:
    """Radii such that fingerprints within max_bits are within the radius in at least one segment (below 0: not needed)."""
    each, rest = divmod(max_bits, segments)
    return [each if i <= rest else each - 1 for i in range(segments)]


def _segments(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of 64 bits."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _key(fp: Column, i: int, shift: int, width: int) -> Column:
    value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return value.bitwiseOR(F.lit(i << 56).cast("long"))


def near_pairs(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS[0][1]) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints of the column fp that differ in at most max_bits bits.

    Each distinct fingerprint is filed under each of its segments and probes the Hamming ball of each segment's radius;
    whole distances are checked inside the join, so no more than the true pairs leave it.
    """
    radii = segment_radii(max_bits, segments)
    parts = [(i, shift, width, radii[i]) for i, (shift, width) in enumerate(_segments(segments)) if radii[i] >= 0]
    fp = F.col("fp")
    distinct = prints.select("fp").where(fp.isNotNull()).distinct()
    filed = distinct.select(fp.alias("b"), F.explode(F.array(*(_key(fp, i, s, w) for i, s, w, _ in parts))).alias("key"))

    def ball(i: int, shift: int, width: int, radius: int) -> Column:
        masks = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: _key(fp, i, shift, width).bitwiseXOR(m))

    probes = distinct.select(fp.alias("a"), F.explode(F.concat(*(ball(*p) for p in parts))).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probes.join(filed, (probes["key"] == filed["key"]) & near).select("a", "b").distinct()


def group(prints: DataFrame, key: str = "doc_id", max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """(key, fp, component_id) for (key, fp): the smallest key that links reach, the row's own included.

    Equal fingerprints are one node, so copies cost one row each and are never paired. Rows without a key keep their
    component. A single row, or none, is its own group. segments: None for as many as suit the number of fingerprints.
    """
    prints = materialize(prints.select(key, "fp"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("_first")), "nodes")
    if segments is None:
        n = nodes.count()
        segments = next(s for most, s in SEGMENTS if n <= most)
    roots = components(near_pairs(prints, max_bits, segments))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    least = labelled.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = labelled.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["_fp"]).select(key, "fp", "component_id")


#: The wide fingerprints of near-duplicate search: lanes of 64 bits, two from each hash of 128; of the key lanes,
#: segments, their width, and how many of a segment's least certain bits span the ball that is enumerated.
LANES, KEY_LANES, LANE_SEGMENTS, SEGMENT_BITS, FREE_BITS = 6, 6, 3, 21, 3
#: Standard deviations by which a distance may exceed its mean at the wanted similarity.
ALLOWANCE = 3


def distance_limit(similarity: float, bits: int = 64 * LANES) -> int:
    """Differing bits up to which shingle sets of like size are compared: the mean at this Jaccard similarity and
    ALLOWANCE deviations, so that pairs that reach it are hardly missed."""
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine)) / np.pi
    return round(share * bits + ALLOWANCE * float(np.sqrt(share * (1 - share) * bits)))


def wide_simhash(text: bytes, words: int) -> tuple[bytes, int, np.ndarray, bytes]:
    """(digest, size, lanes, free): 128 bits that name the set of distinct shingles, its size, its fingerprint, and for
    each segment the places of its FREE_BITS least certain bits, those that an edited copy turns most likely; a byte each."""
    own = set(shingles(text, words))
    digest = xxhash.xxh3_128_digest
    hashes = [np.frombuffer(b"".join([digest(x, SEED + i) for x in own]), np.uint8).reshape(len(own), 16) for i in range(LANES // 2)]
    margin = np.concatenate([bit_counts(h) for h in hashes]) * 2 - len(own)
    lanes = np.packbits(margin > 0).view(">u8").astype(np.uint64).view(np.int64)
    certain = np.abs(margin).reshape(LANES, 64)[:KEY_LANES, : LANE_SEGMENTS * SEGMENT_BITS].reshape(-1, SEGMENT_BITS)
    free = np.argsort(certain, axis=1, kind="stable")[:, :FREE_BITS].astype(np.uint8).tobytes()
    return digest(b"\n".join(sorted(own)), SEED), len(own), lanes, free


def probes(lanes: np.ndarray, free: np.ndarray) -> np.ndarray:
    """(row, probe) of rows of lanes and free places: for each segment its number and the values in which any of its
    free bits are turned, itself first."""
    n, width = len(lanes), KEY_LANES * LANE_SEGMENTS
    shift = np.array([64 - SEGMENT_BITS * (s + 1) for s in range(LANE_SEGMENTS)], np.uint64)
    value = (lanes.view(np.uint64)[:, :KEY_LANES, None] >> shift & np.uint64((1 << SEGMENT_BITS) - 1)).reshape(n, width).astype(np.int64)
    bit = np.int64(1) << (SEGMENT_BITS - 1 - free.reshape(n, width, FREE_BITS).astype(np.int64))
    turned = (np.arange(1 << FREE_BITS)[:, None] >> np.arange(FREE_BITS)) & 1
    masks = (bit[:, :, None, :] * turned).sum(axis=3)
    return ((np.arange(width, dtype=np.int64) << 32)[None, :, None] + (value[:, :, None] ^ masks)).reshape(n, -1)


def wide_fingerprints(df: DataFrame, keys: list[str], text: str, words: int) -> DataFrame:
    """(keys, digest binary, size long, lanes array, free binary) of whole texts."""
    types = {"digest": T.BinaryType(), "size": T.LongType(), "lanes": T.ArrayType(T.LongType()), "free": T.BinaryType()}
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(k, v) for k, v in types.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(len(keys))):
                part = batch.slice(a, b - a)
                prints = zip(*(wide_simhash(x, words) for x in part.column(len(keys)).cast(pa.binary()).to_pylist()), strict=True)
                columns = [pa.array(list(x), k) for x, k in zip(prints, (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *columns], names=schema.names)

    return arrow_map(df.select(*(F.col(f"`{k}`") for k in keys), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")), run, schema)


#: Forests of candidates that each further round looks at.
MORE_FORESTS = 4
#: Documents whose probes a task packs at once, probes that a bucket is to hold, and nodes of one probe that are compared
#: all with all.
PACK_ROWS, BUCKET_PROBES, RUN = 1 << 12, 1 << 16, 64


def _pack(buckets: int):
    """(node, label, size, lanes, free) to (bucket, packed): in each bucket the documents with all but free, and their probes.

    A bucket is a segment's number and as many of its top bits as the number of buckets asks for; so a document's probes
    of a segment share buckets, and its lanes are sent once for each.
    """
    segments = KEY_LANES * LANE_SEGMENTS
    bits = min(SEGMENT_BITS, max(0, (-(-buckets // segments) - 1).bit_length()))

    def flush(about: np.ndarray, free: np.ndarray) -> Iterator[pa.RecordBatch]:
        each = probes(np.ascontiguousarray(about[:, -LANES:]), free)
        probe, owner = each.ravel(), np.repeat(np.arange(len(about)), each.shape[1])
        bucket = ((probe >> 32 << bits) + ((probe & 0xFFFFFFFF) >> (SEGMENT_BITS - bits))) % buckets
        order = np.lexsort((probe, owner, bucket))
        bucket, owner, probe = bucket[order], owner[order], probe[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = []
        for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            own, place = np.unique(owner[a:b], return_inverse=True)
            table = about[own].astype("<i8")
            rows.append((int(bucket[a]), len(own), table.tobytes() + place.astype("<i4").tobytes() + probe[a:b].astype("<i8").tobytes()))
        for at in range(0, len(rows), 256):
            k, n, packed = zip(*rows[at : at + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                lanes = part.column(3).flatten().to_numpy().reshape(part.num_rows, LANES)
                free = utf8(part.column(4))[0].reshape(part.num_rows, -1)
                yield from flush(np.column_stack([*(part.column(i).to_numpy() for i in range(3)), lanes]), free)

    return run


def _unpack(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(probe, node, label, size and lanes) rows."""
    table = np.frombuffer(packed, "<i8", n * (3 + LANES)).reshape(n, 3 + LANES)
    m = (len(packed) - table.nbytes) // 12
    place = np.frombuffer(packed, "<i4", m, table.nbytes)
    return np.frombuffer(packed, "<i8", m, table.nbytes + 4 * m), table[place]


def forest(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) are in the shortest spanning forest: in each round every tree takes its shortest edge out."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(length, kind="stable")
    x, y = place[: len(a)][order], place[len(a) :][order]
    tree, chosen, left = np.arange(len(names)), np.zeros(len(a), bool), np.arange(len(a))
    while len(left := left[tree[x[left]] != tree[y[left]]]):
        p, q, best = tree[x[left]], tree[y[left]], np.full(len(names), len(a))
        best[p[::-1]] = left[::-1]  # the last one written is the shortest
        other = np.full(len(names), len(a))
        other[q[::-1]] = left[::-1]
        best = np.minimum(best, other)
        trees = np.flatnonzero(best < len(a))
        chosen[best[trees]] = True
        up = np.arange(len(names))
        up[trees] = tree[x[best[trees]]] + tree[y[best[trees]]] - trees
        up = np.where((up[up] == np.arange(len(names))) & (np.arange(len(names)) < up), np.arange(len(names)), up)
        while (up[up] != up).any():
            up = up[up]
        tree = up[tree]
    out = np.zeros(len(a), bool)
    out[order] = chosen
    return out


def _candidates(limit: int, similarity: float, forests: int):
    """Buckets of packed probes to pairs (a, b), a < b, of nodes with different labels that share a probe and may be similar
    by distance and size: `forests` shortest spanning forests of the labels, each of edges that those before it left.

    So a bucket gives no more than `forests` pairs for each of its nodes, the likeliest first. Of equal probes, all pairs
    within chunks of RUN are looked at, in the order of the fingerprints; in a longer run also a tree that reaches from one
    node to the next all that are near.
    """

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        few, many = np.minimum(x[..., 2], y[..., 2]), np.maximum(x[..., 2], y[..., 2])
        differ = np.bitwise_count((x[..., 3:] ^ y[..., 3:]).view(np.uint64)).sum(axis=-1, dtype=np.int64)
        return (differ <= limit) & (few >= (similarity - 1e-9) * many) & (x[..., 1] != y[..., 1]), differ

    def tree(rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        left = at
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                one = queue.pop(0)
                hit, differ = near(rows[left], rows[one])
                yield np.full(hit.sum(), one), left[hit], differ[hit]
                queue += left[hit].tolist()
                left = left[~hit]

    def edges(probe: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.append(True, probe[1:] != probe[:-1]))
        size = np.diff(np.append(first, len(probe)))
        for long, n in zip(first[size > RUN].tolist(), size[size > RUN].tolist(), strict=True):
            yield from tree(rows, np.arange(long, long + n))
        at = np.concatenate([np.arange(f, f + n, RUN) for f, n in zip(first[size > RUN].tolist(), size[size > RUN].tolist(), strict=True)] or [first[:0]])
        end = np.minimum(at + RUN, (first + size)[np.searchsorted(first, at, side="right") - 1])
        first, size = np.append(first[size <= RUN], at), np.append(size[size <= RUN], end - at)
        for n in np.unique(size[size > 1]).tolist():
            start = first[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    hit, differ = near(rows[start + i], rows[start + j])
                    yield start[hit] + i, start[hit] + j, differ[hit]

    def pairs(probe: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = [np.concatenate(x) for x in zip(*edges(probe, rows), strict=True)]
        if not found or not len(found[0]):
            return np.zeros((0, 2), np.int64)
        a, b, differ = found
        node = np.sort(np.column_stack([rows[a, 0], rows[b, 0]]), axis=1)
        _, once = np.unique(node, axis=0, return_index=True)
        a, b, differ, node = a[once], b[once], differ[once], node[once]
        out = []
        for _ in range(forests):
            chosen = forest(rows[a, 1], rows[b, 1], differ)
            out.append(node[chosen])
            a, b, differ, node = a[~chosen], b[~chosen], differ[~chosen], node[~chosen]
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in grouped(batches):
            probe, rows = (np.concatenate(x) for x in zip(*(_unpack(n, packed) for _, n, packed in bucket), strict=True))
            order = np.lexsort((rows[:, 0], *(rows[:, i] for i in range(2 + LANES, 2, -1)), probe))
            found = pairs(probe[order], rows[order])
            for part in (found[at : at + (1 << 16)] for at in range(0, len(found), 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    return run


def _pairs(nodes: DataFrame, count: int, similarity: float, forests: int = 1) -> DataFrame:
    """The different candidates (a, b) of `count` nodes (node, label, size, lanes, free)."""
    buckets = 1 + (count * KEY_LANES * LANE_SEGMENTS << FREE_BITS) // BUCKET_PROBES
    packed = arrow_map(nodes.select("node", "label", "size", "lanes", "free"), _pack(buckets), "bucket long, n int, packed binary")
    find = _candidates(distance_limit(similarity), similarity, forests)
    return arrow_map(packed.repartition("bucket").sortWithinPartitions("bucket"), find, "a long, b long").distinct()


def _counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """A written table and how many of its rows there are, or of those where `what` holds."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")), name)
    return out, seen.get["n"]


def shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """(node, grams array) of (node, text): the 64-bit hashes of the distinct shingles; of rows with one node any one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                sets = [np.array([digest(x, SEED) for x in set(shingles(t, words))], np.uint64).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    found = arrow_map(df.select("node", F.coalesce("text", F.lit("")).alias("_text")), run, "node long, grams array<long>")
    return found.dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar): whether the Jaccard similarity of the whole sets reaches the wanted one."""
    one, two = (sets.select(F.col("node").alias(f"_{x}"), F.col("grams").alias(f"_grams_{x}")) for x in "ab")
    both = pairs.join(two, F.col("b") == F.col("_b")).join(one, F.col("a") == F.col("_a"))
    shared = F.size(F.array_intersect("_grams_a", "_grams_b"))
    return both.select("a", "b", (shared / (F.size("_grams_a") + F.size("_grams_b") - shared) >= similarity).alias("similar"))


#: Counters of shingles, of a fixed number: shingles that share one only stand further back in the order.
COUNTERS = 1 << 17


def _counters(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def _how_often(sets: DataFrame) -> np.ndarray:
    """How often shingles of each counter occur in sets(grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_counters(batch.column(0).flatten().to_numpy()), minlength=COUNTERS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    counted = arrow_map(sets.select("grams"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return out


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The different pairs (a, b), a < b, of nodes(node, label) with different labels whose sets(node, grams) may be similar
    by the prefix filter; it loses none that is.

    Sets are put into one order, rare shingles first. Two sets of sizes x and y reach the similarity only if they share
    `most` of their shingles, so the first x - most + 1 of one and the first y - most + 1 of the other have one in common.
    Edited copies of one text share frequent shingles and differ in rare ones, so they meet only if few are edited.
    """
    own = nodes.select(F.col("node").alias("_of"), "label")
    labelled = sets.join(own, F.col("node") == F.col("_of")).select("node", "label", "grams")
    often = sets.sparkSession.sparkContext.broadcast(_how_often(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, label, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.unique(grams.values.to_numpy())
                every = len(own)
                first = min(every, every - int(np.ceil(similarity * every - 1e-6)) + 1)
                own = own[np.lexsort((own, often.value[_counters(own)]))[:first]]
                same = [pa.array(np.full(first, x, np.int64)) for x in (node, label, every)]
                yield pa.RecordBatch.from_arrays([pa.array(own), *same, pa.array(np.arange(first))], names=["gram", "node", "label", "size", "at"])

    rows = materialize(arrow_map(labelled, run, "gram long, node long, label long, size long, at long"), "prefixes")
    one, two = (rows.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "size", "at"))) for x in "ab")
    most = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    fit = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(similarity - 1e-9)
    early = (F.col("at_a") <= F.col("size_a") - most) & (F.col("at_b") <= F.col("size_b") - most)
    met = one.join(two, (one["gram"] == two["gram"]) & (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & fit & early)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


#: Rows to be dropped or compared up to which their ids are broadcast and texts stay where they are; beyond, both are shuffled.
BROADCAST_IDS = 2_000_000


def _linked(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) of nodes whose sets are similar, such that they reach as far as all links do, and (node, root): what they
    reach, for the nodes that have any.

    In each round the candidates that join what no link joins yet are compared, the nearest first, a forest of them for
    each bucket. Two groups between which a link was missed have each a refused candidate on the way to the other: groups
    that have one go into the next round, which looks MORE_FORESTS forests further. Where a round confirms nothing, the
    last one compares every pair between different groups that is left and may be similar by `_prefix_pairs`, so that none
    goes uncompared. Comparisons inside a group grow with its nodes, not with their square; those between groups that stay
    apart are as many as there are pairs that the prefix filter cannot tell apart.
    """
    pairs = materialize(_pairs(nodes.withColumn("label", F.col("node")), nodes.count(), similarity), "candidates")
    members = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    own, n = _counted(nodes.join(members, F.col("node") == F.col("_node")).select("node", F.col("first.id").alias("_id"), F.col("first.t").alias("_t")), "members")
    own = F.broadcast(own) if n <= BROADCAST_IDS else own
    sets = materialize(shingle_sets(texts.join(own, (F.col("id") == F.col("_id")) & (F.col("t") == F.col("_t"))).select("node", "text"), words), "sets")
    tested, n = _counted(_confirmed(pairs, sets, similarity), "tested", ~F.col("similar"))
    similar = tested.where("similar").select("a", "b")
    roots = materialize(components(similar), "roots")
    if not n:
        return similar, roots
    named = nodes.join(roots.toDF("_of", "label"), F.col("node") == F.col("_of"), "left").withColumn("label", F.coalesce("label", "node"))
    refused = tested.where(~F.col("similar")).select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    unsettled = named.join(refused, F.col("node") == F.col("_node"), "left_semi").select(F.col("label").alias("_left")).distinct()
    again, n = _counted(named.join(unsettled, F.col("label") == F.col("_left"), "left_semi").select("node", "label", "size", "lanes", "free"), "again")
    confirmed = 1
    forests: int | None = 1
    while forests:
        forests = forests + MORE_FORESTS if confirmed else None
        more = _pairs(again, n, similarity, forests) if forests else _prefix_pairs(again, sets, similarity)
        more = more.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more, confirmed = _counted(_confirmed(more, sets, similarity), "more", F.col("similar"))
        tested = tested.unionByName(more)
        if not confirmed:
            continue
        found = more.where("similar").select("a", "b")
        similar = similar.unionByName(found)
        of = again.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        for c in ("a", "b"):
            found = found.join(of, F.col(c) == F.col("_node")).select(*(x for x in ("a", "b") if x != c), F.col("_label").alias(c))
        root = components(found).toDF("_old", "_new")
        again = again.join(root, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label"), "size", "lanes", "free")
        again = materialize(again, "again")
    later = again.select("node", F.col("label").alias("root"))
    return similar, roots.join(later, "node", "left_anti").unionByName(later)


def _links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    return _linked(nodes, texts, words, similarity)[0]


def _identity(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """What tells rows apart: the key, a null as the smallest, and the hash of the text, a null as empty."""
    return integer_key(docs, key), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _named(docs: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """(id, t, rows, first) for every distinct identity: its number of rows and the smallest identity of its group."""
    i, t = _identity(docs, key, text)
    texts = docs.select(i.alias("id"), t.alias("t"), F.col(f"`{text}`").alias("text"))
    prints = materialize(wide_fingerprints(texts, ["id", "t"], "text", words), "prints")
    nodes = prints.groupBy("digest").agg(F.min(F.struct("id", "t")).alias("first"), *(F.first(c).alias(c) for c in ("size", "lanes", "free")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _linked(nodes, texts, words, similarity)[1].withColumnRenamed("node", "_node")
    rooted = nodes.join(roots, F.col("node") == F.col("_node"), "left").select(F.col("digest").alias("_digest"), F.coalesce("root", "node").alias("root"))
    counted = prints.groupBy("id", "t", "digest").agg(F.count(F.lit(1)).alias("rows"))
    named = counted.join(rooted, F.col("digest") == F.col("_digest")).select("id", "t", "rows", "root")
    least = named.groupBy("root").agg(F.min(F.struct("id", "t")).alias("first")).withColumnRenamed("root", "_root")
    return named.join(least, F.col("root") == F.col("_root")).select("id", "t", "rows", "first")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id, rows) for every distinct key and text of docs: the smallest key of its group of near-duplicates.

    Two texts are linked if the Jaccard similarity of their sets of `words`-word shingles is at least `similarity`; groups
    are what links reach. Each link is confirmed on the whole sets. Candidates share a probe of a segment and are near in
    their fingerprints, so links are found with high probability, not surely (the README has figures). Equal sets are one
    node. Null and empty texts are equal. A null key counts as the smallest; a shared key alone links nothing.
    """
    return _named(docs, key, text, words, similarity).select(F.col("id").alias(key), F.col("first.id").alias("component_id"), "rows")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group: that with the smallest key, then text hash, of several equal ones any. All columns stay."""
    groups = materialize(_named(docs, key, text, words, similarity), "groups")
    names, docs = docs.columns, by_place(docs)
    i, t = _identity(docs, f"c{names.index(key)}", f"c{names.index(text)}")
    later = groups.where(F.struct("id", "t") != F.col("first")).select(F.col("id").alias("_later_id"), F.col("t").alias("_later_t"))
    later, n = _counted(later, "later")
    later = F.broadcast(later) if n <= BROADCAST_IDS else later
    kept = docs.join(later, (i == F.col("_later_id")) & (t == F.col("_later_t")), "left_anti")
    if groups.where((F.col("rows") > 1) & (F.struct("id", "t") == F.col("first"))).isEmpty():
        return kept.toDF(*names)
    return kept.withColumns({"_same_id": i, "_same_t": t}).dropDuplicates(["_same_id", "_same_t"]).drop("_same_id", "_same_t").toDF(*names)
