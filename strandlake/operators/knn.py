"""Exact nearest neighbours of all samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions.columns import clip
from strandlake.tables import arrow_map, materialize

#: Fewest and most rows of a block, pivots, and how many vectors are looked at for each pivot.
BLOCK_ROWS, PIVOTS, SAMPLE_EACH = (512, 4096), 16, 16
#: Most blocks that a task compares with others at once, and into how many groups for each core they are dealt.
GROUP_BLOCKS, GROUPS_EACH = 16, 4
#: Bytes of distances that a kernel holds at once, and candidates for each wanted neighbour from which a row's k-th is looked for.
CHUNK_BYTES, ROOMY = 8 << 20, 4
#: How far a distance by matrix product may be off, as a share of the squared lengths.
ROUNDING = 1e-11
#: Bytes of single precision bounds that a kernel holds at once, so that they stay in a core's cache; the largest value of a
#: vector for which they are taken.
BOUND_BYTES, BOUND_LARGEST = 1 << 20, 1e150


def features(z: DataFrame, regions: DataFrame, zmax: float = 2.0) -> tuple[DataFrame, int]:
    """((sample_id, vec array of double), number of regions): clipped z in the order of the regions, missing as 0."""
    places = regions.select("start", "end").distinct()
    numbered = places.withColumn("at", F.row_number().over(Window.orderBy("start", "end")) - 1)
    n = numbered.count()
    cells = z.join(numbered, ["start", "end"]).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("at", clip(F.col("z"), zmax).alias("f")))).alias("m"))
    every = z.select("sample_id").distinct().join(cells, "sample_id", "left")
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))) if n else F.array().cast("array<double>")
    return every.select("sample_id", F.coalesce(filled, F.array_repeat(F.lit(0.0), n)).alias("vec")), n


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist())


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by matrix product; off by rounding."""
    out = a @ b.T
    out *= -2.0
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)
    return out


def _first(k: int, i: np.ndarray, d: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The places of the k entries of each i with the least d, then name; in that order."""
    order = np.lexsort((d, i))
    if ((i[order[1:]] == i[order[:-1]]) & (d[order[1:]] == d[order[:-1]])).any():  # names take long to sort
        order = np.lexsort((names, d, i))
    i = i[order]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
    nth = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    return order[nth < k]


def _within(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of a, row of b) in pieces: every pair whose squared distance is within the finite bound of its row of a, and few
    others. One product in single precision gives lower bounds of the distances: the squared lengths that are part of it
    are lessened by as much as all its roundings can come to.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    scale = max(np.abs(a).max(), np.abs(b).max()) or 1.0
    a, b = a / scale, b / scale
    less = 1 - 2.1 * (a.shape[1] + 8) * 2.0**-24
    one, two = np.empty((len(a), a.shape[1] + 2), np.float32), np.empty((len(b), a.shape[1] + 2), np.float32)
    one[:, :-2], one[:, -2], one[:, -1] = a * -2.0, (a * a).sum(axis=1) * less, 1.0
    two[:, :-2], two[:, -2], two[:, -1] = b, 1.0, (b * b).sum(axis=1) * less
    limit = np.minimum(bound / scale / scale * (1 + 1e-6) + 1e-36, 1e30).astype(np.float32)[:, None]
    step = max(1, BOUND_BYTES // (4 * len(b)))
    out = np.empty((min(step, len(a)), len(b)), np.float32)
    for at in range(0, len(a), step):
        low = np.matmul(one[at : at + step], two.T, out=out[: len(a) - at])
        i, j = np.divmod(np.flatnonzero(low <= limit[at : at + step]), len(b))
        if len(i):
            yield at + i, j


def _closer(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _nearest, of vectors and bounds that are finite: the pairs of _within, summed from the differences."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    each = max(1, CHUNK_BYTES // max(8, b.shape[1] * 8))
    for rows, places in _within(a, b, bound):
        for p in range(0, len(rows), each):
            i, j = rows[p : p + each], places[p : p + each]
            exact = ((a[i] - b[j]) ** 2).sum(axis=1)
            kept = (exact <= bound[i]) & (ids[i] != others[j])
            i, j, exact = i[kept], j[kept], exact[kept]
            if len(i) > ROOMY * k:
                kept = _first(k, i, exact, others[j])
                i, j, exact = i[kept], j[kept], exact[kept]
            found.append((i, j, exact))
    i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = _first(k, i, exact, others[j])
    return i[kept], j[kept], exact[kept]


def _nearest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance) of the k nearest, the same id excluded; ties by id; none beyond the bound of
    its row. Candidates come from products, with room for rounding; what is returned is summed from the differences.

    Where the bounds leave few candidates, no k-th distance is looked for among all of them; finite bounds go before
    products in double precision."""
    if bound is not None and k > 0 and len(a) and len(b) and a.shape[1] and np.isfinite(bound).all() and max(np.abs(a).max(), np.abs(b).max()) <= BOUND_LARGEST:
        return _closer(ids, a, others, b, k, bound)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CHUNK_BYTES // max(1, len(b) * 8))
    for at in range(0, len(a) if k > 0 and len(b) else 0, step):
        part = a[at : at + step]
        near = _products(part, b)
        room = 2 * ROUNDING * ((part * part).sum(axis=1) + (b * b).sum(axis=1).max())
        limit = np.full(len(part), np.inf) if bound is None else bound[at : at + step] + room
        hit = near <= limit[:, None]
        if k + 1 < len(b) and np.count_nonzero(hit) > ROOMY * k * len(part):
            reach = np.partition(near, k, axis=1)[:, k]  # one of them may be the row itself
            hit = near <= np.fmin(limit, reach + room)[:, None]
        i, j = np.nonzero(hit)
        other = (ids[at + i] != others[j]) & np.isfinite(near[i, j])
        i, j = i[other], j[other]
        exact = np.empty(len(i))
        each = max(1, CHUNK_BYTES // max(8, b.shape[1] * 8))
        for p in range(0, len(i), each):
            exact[p : p + each] = ((part[i[p : p + each]] - b[j[p : p + each]]) ** 2).sum(axis=1)
        if bound is not None:
            inside = exact <= bound[at + i]
            i, j, exact = i[inside], j[inside], exact[inside]
        kept = _first(k, i, exact, others[j])
        found.append((at + i[kept], j[kept], exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class _Block:
    """A block's rows with the k nearest of each that are known so far."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, near: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.ids, self.vecs, self.k, self.near = ids, vecs, k, near
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.settle()

    def settle(self) -> None:
        """Takes what was found into the k nearest; bounds are the k-th distances, infinite if there are fewer."""
        i, names, d = (np.concatenate(x) for x in zip(self.near, *self.new, strict=True))
        kept = _first(self.k, i, d, names)
        self.near, self.new = (i[kept], names[kept], d[kept]), []
        count = np.bincount(self.near[0], minlength=len(self.ids))
        self.bounds = np.full(len(self.ids), np.inf)
        if self.k:
            self.bounds[count == self.k] = self.near[2][np.cumsum(count)[count == self.k] - 1]

    def meet(self, others: np.ndarray, vecs: np.ndarray) -> None:
        i, j, d = _nearest(self.ids, self.vecs, others, vecs, self.k, self.bounds)
        self.new.append((i, others[j], d))
        if sum(len(x[0]) for x in self.new) >= len(self.near[0]) // 2:
            self.settle()


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most n of the vectors, each far from those before, out of SAMPLE_EACH times as many that a hash picks."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(n * SAMPLE_EACH).select("vec").toArrow().column(0)
    own = _vectors(some)
    picked, least = [0] if len(own) else [], np.full(len(own), np.inf)
    while len(picked) < min(n, len(own)):
        least = np.minimum(least, _products(own, own[picked[-1:]])[:, 0])
        picked.append(int(least.argmax()))
    return own[picked]


def neighbor_blocks(vectors: DataFrame, k: int, key: str = "sample_id", vec: str = "vec", block_rows: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(block, ids, vecs, bounds, bound, low, high, near): one row for each block of about block_rows vectors that lie
    together, the vectors one after another in `vecs`.

    Rows are dealt by range of their nearest pivot and the distance to it. near: the k nearest within the block, by the
    rows' places in it; bounds:
    the squared distance of each row's k-th, infinite if there are fewer; bound: the greatest of them; low, high: the
    least and greatest distance to each pivot. Only the pivots, a fixed number, are looked at by the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    n = rows.count()
    size = block_rows or min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], -(-n // (2 * spark.sparkContext.defaultParallelism))))
    held = spark.sparkContext.broadcast(_pivots(rows, pivots))
    kind = rows.schema["id"].dataType.simpleString()

    def away(vecs: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(_products(vecs, held.value), 0.0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = away(_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=["id", "vec", "pivot", "reach"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b for b in batches if b.num_rows]
        if not own:
            return
        whole = pa.Table.from_batches(own)
        ids, a = _ids(whole.column("id")), _vectors(whole.column("vec"))
        i, j, d = _nearest(ids, a, ids, a, k)
        bounds = np.full(len(ids), np.inf)
        ends = np.cumsum(np.bincount(i, minlength=len(ids)))
        full = np.flatnonzero(np.bincount(i, minlength=len(ids)) == k) if k else np.zeros(0, int)
        bounds[full] = d[ends[full] - 1]
        names, reach = whole.column("id").combine_chunks(), away(a)
        near = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), names.take(pa.array(j)), pa.array(d)], names=["at", "nbr_id", "sq_dist"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
        block = pa.array([TaskContext.get().partitionId()], pa.int32())
        columns = [block, one(names), one(a.ravel()), one(bounds), pa.array([float(bounds.max())]), one(reach.min(axis=0)), one(reach.max(axis=0)), one(near)]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "vecs", "bounds", "bound", "low", "high", "near"])

    placed = arrow_map(rows, place, f"id {kind}, vec array<double>, pivot int, reach double")
    dealt = placed.repartitionByRange(max(1, -(-n // size)), "pivot", "reach", F.xxhash64("id"))
    lists = "vecs array<double>, bounds array<double>, bound double, low array<double>, high array<double>"
    blocks = arrow_map(dealt, within, f"block int, ids array<{kind}>, {lists}, near array<struct<at: int, nbr_id: {kind}, sq_dist: double>>")
    return materialize(blocks, "blocks")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(i, j): the pairs of different blocks of which j can hold one of the k nearest of a row of i.

    By the triangle inequality two rows are at least as far apart as their distances to any pivot differ. A pair is left
    out where that is more than the largest bound of i. What meets here is one short row a block.
    """
    one, two = (blocks.select(*(F.col(c).alias(f"{n}_{c}") for c in ("block", "bound", "low", "high"))) for n in ("i", "j"))
    apart = F.zip_with(F.zip_with("i_low", "j_high", lambda a, b: a - b), F.zip_with("j_low", "i_high", lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = _may_reach(F.coalesce(F.array_max(apart), F.lit(0.0)), F.col("i_bound"), F.array_max("j_high"))
    return one.join(two, (F.col("i_block") != F.col("j_block")) & near).select(F.col("i_block").alias("i"), F.col("j_block").alias("j"))


def _may_reach(least: Column, bound: Column, scale: Column) -> Column:
    """Whether a distance of at least `least` can be within the squared bound; distances to pivots are off by rounding."""
    room = F.lit(1e-6) * (F.lit(1e-3) + F.coalesce(scale, F.lit(0.0)))
    return F.greatest(least - room, F.lit(0.0)) <= F.sqrt(bound) * (1 + 1e-9)


def _flat(batch: pa.RecordBatch, name: str, at: int) -> pa.Array:
    """A cell that holds a list, as an array."""
    return batch.column(name).slice(at, 1).flatten()


def _rows_of(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a block."""
    ids, flat = _ids(_flat(batch, "ids", at)), _flat(batch, "vecs", at).to_numpy()
    return ids, flat.reshape(len(ids), len(flat) // max(1, len(ids)))


def nearest_neighbors(vectors: DataFrame, k: int, key: str = "sample_id", vec: str = "vec", block_rows: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(key, rank int from 1, nbr_id, sq_dist): the k nearest other rows by squared Euclidean distance, ties by id. Exact.

    Vectors that lie together make blocks, each one row; each vector's k nearest within its block bound what is still
    wanted. Of the pairs of blocks only those meet that can hold something nearer by the distances to a few pivots:
    `block_pairs`. Up to GROUP_BLOCKS blocks make a group, to which each block that any of them has to meet is sent once; a
    task holds the group's vectors with the k nearest so far and one other block at a time, so that nothing but the k
    nearest leaves it. Keys must be distinct, vectors of one length; an empty table gives no rows.
    """
    blocks = neighbor_blocks(vectors, k, key, vec, block_rows, pivots)
    kind = vectors.schema[key].dataType.simpleString()
    wide = GROUPS_EACH * vectors.sparkSession.sparkContext.defaultParallelism
    n = blocks.count()
    each = max(1, min(GROUP_BLOCKS, n // wide))

    def ranked(own: dict[int, _Block], names: pa.DataType) -> Iterator[pa.RecordBatch]:
        for block in own.values():
            block.settle()
            i, nbrs, d = block.near
            start = np.searchsorted(i, np.arange(len(block.ids)))
            columns = [pa.array(block.ids[i].tolist(), names), pa.array((np.arange(len(i)) - start[i] + 1).astype(np.int32)), pa.array(nbrs.tolist(), names), pa.array(d)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "rank", "nbr_id", "sq_dist"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, names = None, {}, None
        for batch in batches:
            names = batch.schema.field("ids").type.value_type
            for at in range(batch.num_rows):
                if batch.column("group")[at].as_py() != group:
                    yield from ranked(own, names)
                    group, own = batch.column("group")[at].as_py(), {}
                ids, vecs = _rows_of(batch, at)
                if batch.column("for")[at].as_py() is None:
                    near = _flat(batch, "near", at)
                    i, nbrs, d = near.field("at").to_numpy(), _ids(near.field("nbr_id")), near.field("sq_dist").to_numpy()
                    own[batch.column("block")[at].as_py()] = _Block(ids, vecs, k, (i.astype(int), nbrs if len(nbrs) else ids[:0], d))
                    continue
                for one in batch.column("for")[at].as_py():
                    own[one].meet(ids, vecs)
        if own:
            yield from ranked(own, names)

    of = lambda block: F.floor(block / F.lit(each)).cast("int")
    asked = block_pairs(blocks).groupBy(of(F.col("i")).alias("group"), F.col("j").alias("block")).agg(F.sort_array(F.collect_list("i")).alias("for"))
    kept = blocks.select("block", "ids", "vecs", "near")
    home = kept.select(of(F.col("block")).alias("group"), "block", F.lit(None).cast("array<int>").alias("for"), "ids", "vecs", "near")
    guests = asked.join(kept.drop("near"), "block").select("group", "block", "for", "ids", "vecs", F.lit(None).cast(kept.schema["near"].dataType).alias("near"))
    # A group's own blocks come first.
    met = home.unionByName(guests).repartition(max(1, -(-n // each)), "group").sortWithinPartitions("group", F.col("for").isNotNull())
    found = arrow_map(met, meet, f"id {kind}, rank int, nbr_id {kind}, sq_dist double")
    return found.select(F.col("id").alias(key), "rank", "nbr_id", "sq_dist")


def with_scales(neighbors: DataFrame, scales: DataFrame, n_regions: int) -> DataFrame:
    """(sample_id, scale, rank, nbr_id, nbr_scale, sq_dist, norm_dist): scales of both, 1 if unknown; the distance by
    twice the number of regions (at least 1)."""
    own = scales.select(F.col("sample_id").alias("_s"), F.col("scale").alias("_own"))
    other = scales.select(F.col("sample_id").alias("_n"), F.col("scale").alias("_other"))
    joined = neighbors.join(own, F.col("sample_id") == F.col("_s"), "left").join(other, F.col("nbr_id") == F.col("_n"), "left")
    return joined.select(
        "sample_id", F.coalesce("_own", F.lit(1.0)).alias("scale"), "rank", "nbr_id", F.coalesce("_other", F.lit(1.0)).alias("nbr_scale"),
        "sq_dist", (F.col("sq_dist") / (2.0 * max(1, n_regions))).alias("norm_dist"),
    )


def pairwise_distance(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sq_dist) of the pairs(a, b) asked for, in expressions only."""
    left = vectors.select(F.col("sample_id").alias("a"), F.col("vec").alias("x"))
    right = vectors.select(F.col("sample_id").alias("b"), F.col("vec").alias("y"))
    squares = F.zip_with("x", "y", lambda x, y: (x - y) * (x - y))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.aggregate(squares, F.lit(0.0), lambda s, x: s + x).alias("sq_dist"))
