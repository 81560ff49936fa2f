"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandlake.tables import arrow_map, materialize

#: Edges up to which what is left is settled in one task: moving so few between tasks takes longer, and each of the many
#: small stages of the rounds costs the driver memory.
FEW = 1 << 16


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    sides = _both(edges)
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Here a > b in each edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b")))


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, root = root, root.copy()
        least = np.minimum(before[x], before[y])
        np.minimum.at(root, before[x], least)
        np.minimum.at(root, before[y], least)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _few(edges: DataFrame) -> DataFrame:
    """(node, root) of at most FEW edges (a, b), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if own:
            found = _least(*(np.concatenate(x) for x in zip(*own, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

    return arrow_map(edges.select("a", "b").coalesce(1), run, "node long, root long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of every node that has a link.

    links: pairs of longs in any order; repeated ones and loops do no harm. Both stars aggregate before they join, so a
    node with a great many links is one row of the aggregate, and the join's large side can be split. Rounds end when
    the edges no longer change, or as soon as FEW or less are left: those keep the components, and one task settles them.
    No links give no rows.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    state = None
    while True:
        seen = Observation()
        measure = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        edges = materialize(edges.observe(seen, *measure), "edges")
        now = (seen.get["n"], seen.get["h"])
        if now[0] <= FEW:
            return _few(edges)
        if now == state:
            break
        state = now
        edges = _small_star(_large_star(edges).distinct()).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").toDF("node", "root").distinct())
