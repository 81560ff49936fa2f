"""Haplotype graph, phasing by neighbour means, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions.columns import PRIOR_WEIGHT, hap_node, lorentzian, segment_distance
from strandlake.tables import materialize

#: Rounds of simultaneous sweeps between written tables (a round reads the state twice, so plans double with each), and
#: sequential sweeps that are solved together.
ROUNDS, SWEEPS = 2, 8
#: Greatest change of a value, relative to the sample's total, in a round after which nothing is left to solve.
SETTLED = 1e-12


def ibs_edges(ibs: DataFrame, index: DataFrame, cap: int = 10) -> DataFrame:
    """(node, rank, nbr, w): the first `cap` neighbours of each haplotype in file order, weight 1.

    ibs(line_no, id, hap, nbr_id, nbr_hap) with haplotypes 1 and 2; index(sample_id, idx). Rows with other haplotypes or
    unknown ids are dropped.
    """
    own = index.select(F.col("sample_id").alias("id"), F.col("idx").alias("i"))
    other = index.select(F.col("sample_id").alias("nbr_id"), F.col("idx").alias("j"))
    met = ibs.where("hap in (1, 2) and nbr_hap in (1, 2)").join(own, "id").join(other, "nbr_id")
    edges = met.select("line_no", hap_node(F.col("i"), F.col("hap") - 1).cast("long").alias("node"), hap_node(F.col("j"), F.col("nbr_hap") - 1).cast("long").alias("nbr"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("line_no"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= cap).select("node", "rank", "nbr", F.lit(1.0).alias("w"))


def ibd_edges(
    segments: DataFrame, index: DataFrame, start: int, end: int, cap: int = 10, min_length: float = 0.5, min_match: float = 0.7,
    weighted: bool = False, scale: float = 1_000_000, drop_self: bool = False,
) -> DataFrame:
    """(node, rank, nbr, w): both directions of each segment, the `cap` longest of each haplotype, of equal ones by
    line and side.

    segments(line_no, id1, hap1, id2, hap2, bp1, bp2, length, match), haplotypes as names that end in _0 or _1. Short or
    poorly matching segments, other haplotypes and unknown ids are dropped; the chromosome is not looked at.
    """
    h = [F.substring_index(f"hap{i}", "_", -1) for i in (1, 2)]
    good = segments.where((F.col("length") >= min_length) & (F.col("match") >= min_match) & h[0].isin("0", "1") & h[1].isin("0", "1"))
    one = index.select(F.col("sample_id").alias("id1"), F.col("idx").alias("i"))
    two = index.select(F.col("sample_id").alias("id2"), F.col("idx").alias("j"))
    distance = segment_distance(F.col("bp1"), F.col("bp2"), start, end)
    w = lorentzian(distance, F.col("match"), scale) if weighted else F.lit(1.0)
    met = good.join(one, "id1").join(two, "id2").select(
        "line_no", "length", w.alias("w"), hap_node(F.col("i"), h[0].cast("long")).alias("a"), hap_node(F.col("j"), h[1].cast("long")).alias("b"))
    met = met.where("a <> b") if drop_self else met
    there = met.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "w", "length", "line_no", F.lit(0).alias("side"))
    back = met.select(F.col("b").alias("node"), F.col("a").alias("nbr"), "w", "length", "line_no", F.lit(1).alias("side"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("length"), "line_no", "side"))
    return there.unionByName(back).withColumn("rank", rank).where(F.col("rank") <= cap).select("node", "rank", "nbr", "w")


def adjacency_list(edges: DataFrame) -> DataFrame:
    """(node, degree, nbrs array): the neighbours of each node in rank order; capped, so bounded."""
    return edges.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda x: x["nbr"]).alias("nbrs"))


def phase_init(samples: DataFrame, edges: DataFrame, min_neighbors: int = 1) -> DataFrame:
    """(idx, irr, h0, h1) of samples(idx, irr): half of irr each if both haplotypes have enough neighbours, else null.
    A NaN irr counts as missing."""
    degree = edges.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    per = degree.groupBy(F.floor(F.col("node") / 2).alias("idx")).agg(
        F.coalesce(F.max(F.when(F.col("node") % 2 == 0, F.col("d"))), F.lit(0)).alias("d0"), F.coalesce(F.max(F.when(F.col("node") % 2 == 1, F.col("d"))), F.lit(0)).alias("d1"))
    joined = samples.select("idx", F.nanvl("irr", F.lit(None).cast("double")).alias("irr")).join(per, "idx", "left")
    enough = (F.least(F.coalesce("d0", F.lit(0)), F.coalesce("d1", F.lit(0))) >= min_neighbors) & F.col("irr").isNotNull()
    half = F.when(enough, F.col("irr") / 2)
    return joined.select("idx", "irr", half.alias("h0"), half.alias("h1"))


def neighbor_means(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, s0, w0, s1, w1): weighted sums of the neighbours' values and of their weights for both haplotypes."""
    values = state.select(F.explode(F.array(F.struct((F.col("idx") * 2).alias("nbr"), F.col("h0").alias("v")), F.struct((F.col("idx") * 2 + 1).alias("nbr"), F.col("h1").alias("v")))).alias("x")).select("x.*").where("v is not null")
    met = edges.join(values, "nbr").groupBy("node").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("sw"))
    side = F.col("node") % 2
    return met.groupBy(F.floor(F.col("node") / 2).alias("idx")).agg(*(F.sum(F.when(side == h, F.col(c))).alias(f"{n}{h}") for h in (0, 1) for c, n in (("s", "s"), ("sw", "w"))))


def _updated(state: DataFrame, edges: DataFrame) -> DataFrame:
    m = [F.coalesce(F.col(f"s{h}"), F.lit(0.0)) / (F.lit(PRIOR_WEIGHT) + F.coalesce(F.col(f"w{h}"), F.lit(0.0))) for h in (0, 1)]
    total = m[0] + m[1]
    new = [F.when(F.col(f"h{h}").isNull(), F.lit(None).cast("double")).when(total > 0, F.col("irr") * m[h] / total).otherwise(F.col(f"h{h}")) for h in (0, 1)]
    return state.join(neighbor_means(state, edges), "idx", "left").select("idx", "irr", new[0].alias("h0"), new[1].alias("h1"))


def phase_jacobi(state: DataFrame, edges: DataFrame, n_iters: int) -> DataFrame:
    """Simultaneous sweeps: each round is two joins over all nodes; every few rounds a table cuts the lineage."""
    edges = materialize(edges, "edges") if n_iters > 1 else edges
    for i in range(1, n_iters + 1):
        state = _updated(state, edges)
        if i % ROUNDS == 0 and i < n_iters:
            state = materialize(state, f"round{i}")
    return state


def _path(start: Column, n: int) -> Column:
    """A value before and after each of n sweeps, as a first guess all the same."""
    return F.when(start.isNotNull(), F.array_repeat(start, n + 1))


def _improved(state: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """One round: every value of every sweep anew from the neighbours' values as they are now known.

    state(idx, irr, p0, p1) with paths; edges(node, rank, nbr, w, earlier), earlier: the neighbour's sample comes first in
    a sweep. Of such a neighbour the value of the same sweep counts, of others that of the sweep before. Sums go by rank,
    so that a round with the same input gives the same bits. A node's edges are capped, so its list is bounded.
    """
    sides = F.explode(F.array(*(F.struct((F.col("idx") * 2 + h).alias("nbr"), F.col(f"p{h}").alias("p")) for h in (0, 1))))
    known = state.where("p0 is not null").select(sides.alias("x")).select("x.*")
    path = F.slice("p", F.when(F.col("earlier"), 2).otherwise(1), F.lit(n))
    met = edges.join(known, "nbr").select(F.floor(F.col("node") / 2).alias("idx"), F.struct((F.col("node") % 2).alias("side"), "rank", "nbr", "w", path.alias("v")).alias("e"))
    lists = met.groupBy("idx").agg(F.array_sort(F.collect_list("e")).alias("es"))
    joined = state.join(lists, "idx", "left")
    zeros = F.array_repeat(F.lit(0.0), n)

    def means(side: int) -> Column:
        own = F.filter(F.coalesce("es", F.array().cast(lists.schema["es"].dataType)), lambda e: e["side"] == side)
        weight = F.aggregate(own, F.lit(0.0), lambda s, e: s + e["w"]) + F.lit(PRIOR_WEIGHT)
        return F.transform(F.aggregate(own, zeros, lambda s, e: F.zip_with(s, e["v"], lambda x, v: x + e["w"] * v)), lambda x: x / weight)

    both = joined.withColumns({"m0": means(0), "m1": means(1)})
    total = F.zip_with("m0", "m1", lambda a, b: a + b)

    def path_of(h: int) -> Column:
        share = F.transform(F.zip_with(f"m{h}", total, lambda m, t: F.struct(m.alias("m"), t.alias("t"))), lambda x, i: F.when(x["t"] > 0, F.col("irr") * x["m"] / x["t"]).otherwise(F.get(f"p{h}", i)))
        return F.when(F.col(f"p{h}").isNotNull(), F.concat(F.slice(f"p{h}", 1, 1), share))

    moved = F.array_max(F.zip_with("p0", path_of(0), lambda a, b: F.abs(a - b))) / F.abs("irr")
    return both.select("idx", "irr", path_of(0).alias("p0"), path_of(1).alias("p1"), F.when(F.col("irr") != 0, moved).alias("moved"))


def phase_gauss_seidel(state: DataFrame, edges: DataFrame, n_iters: int, sweeps: int = SWEEPS, settled: float = SETTLED) -> DataFrame:
    """Sweeps in the order of the samples, each using what the earlier ones of the same sweep have written; distributed,
    with the result of the sequential sweep.

    A value of a sweep depends on earlier samples' values of the sweep and on later ones' of the sweep before, and on
    nothing in a circle: the values of several sweeps are one system of equations with one solution. Each round takes
    every right side anew; those that depend on nothing are right after one round, those on them after two, and so on by
    levels. When a round changes nothing (more than `settled`, which rounding does), every equation holds. Averages forget
    what is far away, so that this comes long before as many rounds as there are levels. `sweeps` are solved at once, and
    each round is a written table of two short lists a sample.
    """
    known = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    later = F.floor(F.col("nbr") / 2) < F.floor(F.col("node") / 2)
    edges = materialize(edges.select("node", "rank", "nbr", "w", later.alias("earlier")), "edges")
    own = state.select("idx", known("irr").alias("irr"), known("h0").alias("h0"), known("h1").alias("h1"))
    for done in range(0, n_iters, sweeps):
        n = min(sweeps, n_iters - done)
        paths = own.select("idx", "irr", _path(F.col("h0"), n).alias("p0"), _path(F.col("h1"), n).alias("p1"))
        while True:
            seen = Observation()
            paths = materialize(_improved(paths, edges, n).observe(seen, F.max("moved").alias("moved")).drop("moved"), "paths")
            if (seen.get["moved"] or 0.0) <= settled:
                break
        own = paths.select("idx", "irr", *(F.get(f"p{h}", F.lit(n)).alias(f"h{h}") for h in (0, 1)))
    return own


def haplotype_output(state: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(sample_id, irrs, hap1phased, hap2phased, hap1imp, hap2imp): phased values (null if not phased), and for every
    sample its neighbours' mean, or without any half of the mean irr of phased samples (0 if there is none)."""
    fallback = state.where("h0 is not null").agg(F.coalesce(F.avg("irr") / 2, F.lit(0.0)).alias("m")).scalar()
    imputed = [F.when(F.coalesce(F.col(f"w{h}"), F.lit(0.0)) > 1e-9, F.col(f"s{h}") / (F.lit(PRIOR_WEIGHT) + F.col(f"w{h}"))).otherwise(fallback) for h in (0, 1)]
    joined = state.join(neighbor_means(state, edges), "idx", "left").join(names.select("idx", "sample_id"), "idx")
    return joined.select("sample_id", F.col("irr").alias("irrs"), F.col("h0").alias("hap1phased"), F.col("h1").alias("hap2phased"), imputed[0].alias("hap1imp"), imputed[1].alias("hap2imp"))


def haplotype_cn(samples: DataFrame, edges: DataFrame, names: DataFrame, min_neighbors: int = 1, n_iters: int = 100, method: str = "gauss_seidel") -> DataFrame:
    """The whole step on samples(idx, irr)."""
    start = phase_init(samples, edges, min_neighbors)
    state = phase_jacobi(start, edges, n_iters) if method == "jacobi" else phase_gauss_seidel(start, edges, n_iters)
    return haplotype_output(state, edges, names)


def phasable(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (samples, mean_irr, mean_degree) of the samples that are phased and of the nodes that have neighbours."""
    degree = edges.agg((F.count(F.lit(1)) / F.count_distinct("node")).alias("d")).scalar()
    return state.where("h0 is not null").agg(F.count(F.lit(1)).alias("samples"), F.avg("irr").alias("mean_irr")).withColumn("mean_degree", degree)
