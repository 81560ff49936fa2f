"""Small cases of the read-depth operators, each with the value it must give."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.operators import coverage, dipcn, files, genmap, graph, haplotype, intervals, knn, normalize, numbering, reads


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize(
    "bins, region, want",
    [
        ([("S", "chr6", 1000, 2000, 20.0), ("S", "chr6", 2000, 3000, 40.0)], (1000, 3000), 3000),
        ([("S", "chr6", 0, 2000, 40.0)], (1000, 2000), 4000),
        ([("S", "chr7", 0, 2000, 40.0)], (1000, 2000), 0),
        ([("S", "chr6", 5000, 6000, 40.0)], (1000, 2000), 0),
        ([], (1000, 2000), 0),
        ([("S", "chr6", 0, 1, 0.005), ("S", "chr6", 1, 2, 0.025)], (0, 2), 2),
        ([("S", "chr6", 0, 8, 0.125)], (0, 8), 12),
    ],
)
def test_region_coverage(spark, bins, region, want):
    df = spark.createDataFrame(bins, "sample_id string, chrom string, start long, end long, depth double")
    samples = spark.createDataFrame([("S",)], "sample_id string")
    assert rows(coverage.region_coverage(df, samples, "chr6", *region)) == [("S", want)]


def test_overlap_join_meets_each_pair_once(spark):
    rng = random.Random(3)
    b = [("S", "chr6", s := rng.randrange(5000), s + rng.randrange(1, 3000), 1.0) for _ in range(60)]
    r = [(f"r{i}", "chr6", s := rng.randrange(5000), s + rng.randrange(1, 3000)) for i in range(20)]
    got = intervals.overlap_join(spark.createDataFrame(b, "sample_id string, chrom string, start long, end long, depth double"), spark.createDataFrame(r, "region string, chrom string, r_start long, r_end long"), cell=700)
    want = sorted((x[2], x[3], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in b for y in r if min(x[3], y[3]) > max(x[2], y[2]))
    assert rows(got.select("start", "end", "region", "overlap")) == want


def test_read_filter_and_zero_counts(spark):
    aln = [
        ("A", "chr6", 100, 83, 10, "chr6"), ("A", "chr6", 100, 1107, 10, "chr6"), ("A", "chr6", 100, 339, 10, "chr6"), ("A", "chr6", 200, 83, 10, "chr6"),
        ("A", "chr6", 199, 83, 0, "chr6"), ("A", "chr6", 150, 83, 10, "chrX"), ("A", "chr7", 150, 83, 10, "chr7"), ("A", "chr6", 150, 99, 10, "chr6"),
    ]
    df = spark.createDataFrame(aln, "sample_id string, chrom string, pos long, flag int, mapq int, next_chrom string")
    samples = spark.createDataFrame([("A",), ("B",)], "sample_id string")
    assert rows(reads.count_reads(df, samples, "chr6", 100, 200, [83, 1107, 339], 1)) == [("A", 1), ("B", 0)]
    assert rows(reads.count_reads(df, samples, "chr6", 100, 200, [], 1)) == [("A", 0), ("B", 0)]


def test_mask(spark):
    mask = spark.createDataFrame([("chr6", 1000, 3000), ("6", 0, 1000)], "chrom string, start long, end long")
    assert rows(intervals.mask_kb(mask)) == [("chr6", 0), ("chr6", 1), ("chr6", 2), ("chr6", 3)]


BINS = "sample_id string, chrom string, start long, end long, depth double"


def test_bins_touch_region_and_mask(spark):
    df = spark.createDataFrame([("S", "chr6", 1000, 2000, 30.0), ("S", "6", 5000, 6000, 30.0), ("S", "chr6", 0, 1000, 30.0), ("S", "chr6", 1000, 2000, 0.0), ("S", "chr16", 1000, 2000, 5.0)], BINS)
    got = intervals.bins_in_region(df, "chr6", 1000, 3000)
    assert [(r[2], r[4]) for r in rows(got)] == [(0, 30.0), (1000, 30.0)]
    cells = spark.createDataFrame([("chr6", 2)], "chrom string, kb long")
    assert [r[2] for r in rows(intervals.unmasked(got, cells))] == [0]


CELLS = "sample_id string, start long, end long, depth double"


def test_normalise_with_missing_cells_matches_numpy(spark):
    rng = np.random.default_rng(5)
    d = rng.uniform(20, 60, (7, 5))
    d[rng.random((7, 5)) < 0.2] = np.nan
    cells = [(f"S{i}", j * 1000, j * 1000 + 1000, float(d[i, j])) for i in range(7) for j in range(5) if not np.isnan(d[i, j])]
    df = spark.createDataFrame(cells, CELLS)
    x = d / np.nanmean(d, axis=1, keepdims=True)
    mu = np.nanmean(x, axis=0)
    var = np.nansum((x - mu) ** 2, axis=0) / 6
    ratio = 100 * var / mu
    stats = normalize.region_stats(df)
    got = stats.orderBy("start").collect()
    assert np.allclose([r["mu"] for r in got], mu) and np.allclose([r["var"] for r in got], var) and np.allclose([r["ratio"] for r in got], ratio)
    z = (x - mu) / np.sqrt(mu) / math.sqrt(np.median(ratio) / 100)
    for r in normalize.z_matrix(df, stats).collect():
        assert math.isclose(r["z"], z[int(r["sample_id"][1:]), r["start"] // 1000], abs_tol=1e-9)


def test_one_sample_selects_nothing(spark):
    stats = normalize.region_stats(spark.createDataFrame([("S", 0, 1, 2.0)], CELLS))
    assert stats.first()["var"] is None and rows(normalize.selected_regions(stats, 0.1)) == []


def _stats(spark, ratios):
    return spark.createDataFrame([(i, i + 1, r) for i, r in enumerate(ratios)], "start long, end long, ratio double")


def test_bounds_come_from_the_rows_that_they_are_held_against(spark):
    """Ratios that every evaluation gives anew, as sums in another order do: the row at the bound's place stays or goes."""
    anew = F.udf(lambda i: i + random.random(), "double").asNondeterministic()
    stats = spark.range(9).select(F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.lit(1.0).alias("mu"), F.lit(1.0).alias("var"), anew(F.col("id") * 0).alias("ratio"))
    for _ in range(4):
        assert len(rows(normalize.variance_filter(stats, frac_r=0.5))) == 5
        assert len(rows(normalize.selected_regions(stats, 0.5))) == 4


def test_selection_and_variance_filter(spark):
    assert [r[2] for r in rows(normalize.selected_regions(_stats(spark, [1.0, 5.0, 10.0, 2.0]), 0.5))] == [10.0]
    with pytest.raises(ValueError):
        normalize.selected_regions(_stats(spark, [1.0]), 1.0)
    assert [r[0] for r in rows(normalize.variance_filter(_stats(spark, [1.0, 5.0, 1000.5, 200.0])))] == [0, 1, 3]
    assert len(rows(normalize.variance_filter(_stats(spark, [None, None])))) == 2
    assert [r[0] for r in rows(normalize.variance_filter(_stats(spark, [1.0, 2.0, 3.0, 4.0]), frac_r=0.5))] == [2, 3]


def test_clip(spark):
    df = spark.createDataFrame([(5.0,), (-5.0,), (None,), (float("nan"),), (1.0,)], "z double")
    assert [r[0] for r in df.select(C.clip(F.col("z"), 2.0)).collect()] == [2.0, -2.0, 0.0, 0.0, 1.0]


VECS = "sample_id string, vec array<double>"


def test_neighbors_by_broadcast_and_by_blocks_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (50, 6)).astype(float)
    df = spark.createDataFrame([(f"S{i:02d}", x.tolist()) for i, x in enumerate(v)], VECS)
    want = []
    for i in range(50):
        d = ((v - v[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(50), d)) if j != i][:4]
        want += [(f"S{i:02d}", r, f"S{j:02d}", d[j]) for r, j in enumerate(order, 1)]
    assert rows(knn.nearest_neighbors(df, 4)) == want
    assert rows(knn.nearest_neighbors(df, 4, block_rows=7)) == want


def test_neighbors_small(spark):
    df = spark.createDataFrame([("A", [0.0, 0.0]), ("B", [3.0, 4.0])], VECS)
    assert rows(knn.nearest_neighbors(df, 10)) == [("A", 1, "B", 25.0), ("B", 1, "A", 25.0)]
    scaled = knn.with_scales(knn.nearest_neighbors(df, 1), spark.createDataFrame([("A", 2.0)], "sample_id string, scale double"), 0)
    assert [(r["scale"], r["nbr_scale"], r["norm_dist"]) for r in scaled.orderBy("sample_id").collect()] == [(2.0, 1.0, 12.5), (1.0, 2.0, 12.5)]


NEAR = "sample_id string, scale double, rank int, nbr_id string, nbr_scale double"


def test_diploid_cn(spark):
    near = spark.createDataFrame([("S1", 1.0, 1, "S2", 1.0), ("S1", 1.0, 2, "S3", 1.0), ("S2", 1.0, 1, "S1", 1.0), ("S2", 1.0, 2, "S3", 1.0), ("S3", 1.0, 1, "S1", 1.0), ("S3", 1.0, 2, "S2", 1.0)], NEAR)
    counts = spark.createDataFrame([("S1", 100.0), ("S2", 90.0), ("S3", 110.0)], "sample_id string, reads double")
    assert dict(rows(dipcn.diploid_cn(near, counts, 300))) == pytest.approx({"S1": 1.0, "S2": 90 / 105, "S3": 110 / 95})
    some = counts.where("sample_id <> 'S2'")
    assert dict(rows(dipcn.diploid_cn(near, some, 1))) == pytest.approx({"S1": 100 / 110, "S3": 1.1})
    assert rows(dipcn.missing_neighbors(near, some)) == [("S2", 2)]


def test_exon_counts_and_cn(spark):
    counts = spark.createDataFrame([("S1", 10, 5, 3, 7), ("S2", 5, None, 1, 7), ("S3", 0, 0, 0, 0)], "sample_id string, kiv3 long, kiv2 long, tied long, exon1a long")
    got = counts.where("sample_id = 'S1'").select(*(C.exon_count(k).alias(k) for k in ("1B_KIV3", "1B_notKIV3", "1B", "1A"))).first()
    assert tuple(got) == (10, 8, 18, 7)
    with pytest.raises(ValueError):
        C.exon_count("2C")
    near = spark.createDataFrame([("S1", 1.0, 1, "S3", 1.0), ("S1", 1.0, 2, "S2", 1.0), ("S2", 1.0, 1, "S1", 1.0), ("S3", 1.0, 1, "S1", 1.0)], NEAR)
    assert dict(rows(dipcn.exon_cn(counts, near, "1B", 2))) == pytest.approx({"S1": 3.0, "S2": 6 / 18})
    assert dict(rows(dipcn.exon_cn(counts, near, "1B", 1))) == pytest.approx({"S2": 6 / 18})


def test_ids(spark):
    names = [("NWD123.cram",), ("NWD123.bam",), ("NWD123.b38.irc.v1_subset",), ("  NWD123 ",)]
    assert {r[0] for r in spark.createDataFrame(names, "n string").select(C.normalize_sample_id(F.col("n"))).collect()} == {"NWD123"}
    with pytest.raises(ValueError):
        C.region_string("chr6", None, 5)


IBS = "line_no int, id string, hap int, nbr_id string, nbr_hap int"


def test_ibs_edges(spark):
    index = spark.createDataFrame([("1001", 0), ("1002", 1)], "sample_id string, idx long")
    lines = spark.createDataFrame([(1, "1001", 1, "1002", 2), (2, "1001", 1, "1001", 1), (3, "1001", 3, "1002", 1), (4, "9", 1, "1002", 1)], IBS)
    assert rows(haplotype.ibs_edges(lines, index)) == [(0, 1, 3, 1.0), (0, 2, 0, 1.0)]
    assert rows(haplotype.ibs_edges(lines, index, 1)) == [(0, 1, 3, 1.0)]


def test_ibd_edges(spark):
    index = spark.createDataFrame([("A", 0), ("B", 1)], "sample_id string, idx long")
    kind = "line_no int, id1 string, hap1 string, id2 string, hap2 string, bp1 long, bp2 long, length double, match double"
    lines = spark.createDataFrame([(1, "A", "A_0", "B", "B_1", 100, 200, 3.2, 0.95), (2, "A", "A_0", "B", "B_0", 1, 2, 5.0, 0.9), (3, "A", "A_0", "B", "B_1", 1, 2, 0.4, 0.9), (4, "A", "A_2", "B", "B_1", 1, 2, 9.0, 0.9)], kind)
    got = rows(haplotype.ibd_edges(lines, index, 300, 400))
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (2, 1, 0, 1.0), (3, 1, 0, 1.0)]
    weighted = {r[:3]: r[3] for r in rows(haplotype.ibd_edges(lines, index, 300, 400, weighted=True, scale=100))}
    assert weighted[(0, 2, 3)] == pytest.approx(100 / 200 * 0.95)


def _brute_neighbors(points, k):
    out = []
    for i, a in points:
        near = sorted((float(((np.array(a) - np.array(b)) ** 2).sum()), j) for j, b in points if j != i)
        out += [(i, r, j, d) for r, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "k", "block_rows"), [("clusters", 5, 20), ("clusters", 30, 20), ("same", 4, 10), ("line", 3, 16), ("few", 9, 64)])
def test_neighbors_by_blocks(spark, kind, k, block_rows):
    """Exact also where many points are one, where distances tie, where a block has fewer points than are wanted; and of
    far clusters most pairs of blocks never meet."""
    rng = random.Random(7)
    n = 5 if kind == "few" else 160
    place = {
        "clusters": lambda i: [1000.0 * (i % 8) + rng.gauss(0, 1), 500.0 * (i % 4) + rng.gauss(0, 1), rng.gauss(0, 1)], "same": lambda i: [float(i % 3 == 0), 2.0],
        "line": lambda i: [float(i)], "few": lambda i: [float(i * i), 0.0],
    }[kind]
    points = [(i * 7 % 1009, place(i)) for i in range(n)]
    df = spark.createDataFrame(points, "sample_id long, vec array<double>").repartition(3)
    got = sorted((r["sample_id"], r["rank"], r["nbr_id"], r["sq_dist"]) for r in knn.nearest_neighbors(df, k, block_rows=block_rows).collect())
    assert got == _brute_neighbors(points, k)


def test_pairs_of_far_blocks_do_not_meet(spark):
    rng = random.Random(8)
    points = [(i, [1000.0 * (i % 8) + rng.gauss(0, 1), 500.0 * (i % 4) + rng.gauss(0, 1)]) for i in range(800)]
    df = spark.createDataFrame(points, "sample_id long, vec array<double>")
    blocks = knn.neighbor_blocks(df, 3, block_rows=25)
    count = blocks.select("block").distinct().count()
    assert count >= 24 and knn.block_pairs(blocks).count() < 0.5 * count * (count - 1)
    got = sorted((r["sample_id"], r["rank"], r["nbr_id"], r["sq_dist"]) for r in knn.nearest_neighbors(df, 3, block_rows=25).collect())
    assert got == _brute_neighbors(points, 3)


def test_nearest_neighbors_of_groups_of_blocks(spark):
    """More blocks than groups, so that tasks hold several of them, with equal points in different blocks."""
    rng = random.Random(5)
    points = [(i, [float(rng.randrange(7)), float(rng.randrange(7))]) for i in range(480)]
    want = sorted((i, r, j, d) for i, a in points for r, (d, j) in enumerate(sorted((float(((np.array(a) - np.array(b)) ** 2).sum()), j) for j, b in points if j != i)[:4], 1))
    df = spark.createDataFrame(points, "sample_id long, vec array<double>").repartition(5)
    found = knn.nearest_neighbors(df, 4, block_rows=8)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # no more than the k nearest leave a task


def test_nearest_holds_few_distances():
    rng = np.random.default_rng(3)
    ids, a, b = np.arange(4096), rng.normal(size=(4096, 16)), rng.normal(size=(4096, 16))
    tracemalloc.start()
    knn._nearest(ids, a, ids + 4096, b, 5, np.full(4096, 4.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_neighbors_of_nothing(spark):
    assert knn.nearest_neighbors(spark.createDataFrame([], "sample_id string, vec array<double>"), 3).collect() == []
    assert knn.nearest_neighbors(spark.createDataFrame([("A", [])], "sample_id string, vec array<double>"), 3).collect() == []


def _sweep(irr, edges, n, start):
    h = list(start)
    for _ in range(n):
        for i in range(len(irr)):
            if h[2 * i] is None:
                continue
            m = []
            for k in (0, 1):
                e = [(w, h[b]) for a, _, b, w in edges if a == 2 * i + k and h[b] is not None]
                m.append(sum(w * v for w, v in e) / (1e-9 + sum(w for w, _ in e)))
            if sum(m) > 0:
                h[2 * i], h[2 * i + 1] = irr[i] * m[0] / sum(m), irr[i] * m[1] / sum(m)
    return h


@pytest.mark.parametrize(("kind", "n", "sweeps"), [("random", 3, 2), ("chain", 2, 8), ("self", 2, 8), ("zero", 2, 8), ("none", 2, 8), ("alone", 0, 8)])
def test_gauss_seidel_is_the_sequential_sweep(spark, kind, n, sweeps):
    """To the last places, on graphs with loops, with a chain through all samples in order, with itself as a neighbour,
    with values and sums of 0, and without edges."""
    rng = random.Random(n * 7 + len(kind))
    size = 20
    irr = [0.0 if kind == "zero" and i % 3 else rng.uniform(1, 9) for i in range(size)]
    if kind == "chain":
        near = {i: [i - 1 if i else size - 1] * 2 for i in range(size)}
    else:
        near = {i: [i if kind == "self" and i % 2 else rng.randrange(size) for _ in range(4)] for i in range(size) if i != 4}
    edges = [] if kind == "none" else [(2 * i + k, r, 2 * j + rng.randrange(2), rng.uniform(0.5, 2)) for i, js in near.items() for k in (0, 1) for r, j in enumerate(js, 1)]
    e = spark.createDataFrame(edges, "node long, rank int, nbr long, w double")
    state = haplotype.phase_init(spark.createDataFrame(list(enumerate(irr)), "idx long, irr double"), e)
    begin = [x for r in state.orderBy("idx").collect() for x in (r["h0"], r["h1"])]
    got = [x for r in haplotype.phase_gauss_seidel(state, e, n, sweeps).orderBy("idx").collect() for x in (r["h0"], r["h1"])]
    want = _sweep(irr, edges, n, begin)
    assert [g is None for g in got] == [w is None for w in want] and (kind != "random" or begin[8] is None)
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-12, abs=0)


def test_gauss_seidel_has_no_single_group(spark):
    """No step deals all rows to one task: each exchange of the last round is by a column."""
    e = spark.createDataFrame([(2 * i, 1, (2 * i + 3) % 40, 1.0) for i in range(20)], "node long, rank int, nbr long, w double")
    state = haplotype.phase_init(spark.createDataFrame([(i, 1.0) for i in range(20)], "idx long, irr double"), e, 0)
    plan = haplotype._improved(state.select("idx", "irr", F.array("h0", "h0").alias("p0"), F.array("h1", "h1").alias("p1")), e.withColumn("earlier", F.lit(True)), 1)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "FlatMapGroups" not in plan


def test_imputation_fallback(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (1, 1, 3, 1.0), (2, 1, 0, 1.0), (3, 1, 1, 1.0)], "node long, rank int, nbr long, w double")
    samples = spark.createDataFrame([(0, 4.0), (1, 6.0), (2, 9.0)], "idx long, irr double")
    names = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "sample_id string, idx long")
    got = {r["sample_id"]: r for r in haplotype.haplotype_cn(samples, e, names, n_iters=3, method="jacobi").collect()}
    assert got["C"]["hap1phased"] is None and got["C"]["hap1imp"] == pytest.approx(2.5)
    assert got["A"]["hap1imp"] == pytest.approx(got["B"]["hap1phased"])


def test_interpolation_clamps(spark):
    knots = spark.createDataFrame([(1, 10.0), (3, 30.0), (3, 30.0)], "position long, cm double")
    q = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,), (None,)], "bp long")
    got = {r["bp"]: r["cm"] for r in genmap.interpolate(q, knots, cell=2).collect()}
    assert got == {0: 10.0, 1: 10.0, 2: 20.0, 3: 30.0, 9: 30.0, None: None}


def test_index_status(spark):
    samples = spark.createDataFrame([("S1",), ("S2",), ("S3",), ("S10",)], "sample_id string")
    listing = spark.createDataFrame([("/d/S1.cram",), ("/d/S1.cram.crai",), ("/d/S2.cram",), ("/d/S10.cram",), ("/d/S10.crai",)], "path string")
    assert rows(files.file_status(samples, listing, "cram")) == [("S1", "has_index"), ("S10", "has_index"), ("S2", "missing_index"), ("S3", "missing_file")]


def test_components_of_few_edges_are_one_round(spark, monkeypatch):
    """A path takes several rounds of stars, and one table where one task may settle it; both give the same."""
    df, written = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), []
    monkeypatch.setattr(graph, "materialize", lambda d, name, own=graph.materialize: (written.append(name), own(d, name))[1])
    assert rows(graph.components(df)) == [(i, 0) for i in range(51)]
    assert len(written) == 1
    monkeypatch.setattr(graph, "FEW", -1)
    assert rows(graph.components(df)) == [(i, 0) for i in range(51)]
    assert len(written) > 3


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in {n for a, b in links if a != b for n in (a, b)})
    assert rows(graph.components(spark.createDataFrame(links, "a long, b long"))) == want
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


@pytest.mark.parametrize(("bin_size", "cell"), [(10, 40), (7, 1), (1000, 1 << 20), (3, 30)])
def test_depth_by_covered_blocks(spark, bin_size, cell):
    """Against a count at every place: deletions, skips, clips, reads over the ends, far from each other and on two
    chromosomes; samples without reads have bins too."""
    import re

    rng = random.Random(bin_size)
    lengths = {"chr1": 203, "chr2": 95, "chr3": 50}
    reads = [("A", rng.choice(["chr1", "chr2", "chr9"]), rng.choice([rng.randrange(200), 0, 90]), rng.choice(["10M", "5S4M2D6M3I2=1X9H", "3M120N4M", "8I", "*", "300M", "0M5M", None])) for _ in range(60)]
    reads += [("B", "chr1", -1, "5M"), ("B", "chr1", 202, "5M"), ("B", "chr1", 203, "5M"), ("B", "chr2", 1, "1M")]
    want = {}
    for s, c, p, cigar in reads:
        at = p
        for n, op in re.findall(r"(\d+)(.)", cigar or ""):
            if op in "M=X" and p >= 0:
                for x in range(at, at + int(n)):
                    want[s, c, x] = want.get((s, c, x), 0) + 1
            at += int(n) if op in "MDN=X" else 0
    got = coverage.binned_depth_by_blocks(
        spark.createDataFrame(reads, "sample_id string, chrom string, pos long, cigar string"), spark.createDataFrame([("A",), ("B",), ("C",)], "sample_id string"), bin_size,
        spark.createDataFrame(list(lengths.items()), "chrom string, length int"), cell,
    ).collect()
    assert len(got) == sum(3 * -(-n // bin_size) for n in lengths.values())
    for r in got:
        assert r["end"] == min(r["start"] + bin_size, lengths[r["chrom"]])
        places = range(r["start"], r["end"])
        assert r["depth"] == pytest.approx(sum(want.get((r["sample_id"], r["chrom"], x), 0) for x in places) / len(places))


def test_files_by_names_inside(spark):
    """A file that begins with a sample's name is that sample's alone; a run's name before it does not hide the sample."""
    paths = ["/d/run7_S1_x.cram", "/d/S10_a.cram", "/d/S10.b.cram", "/d/run_S3.bam", "/S4/none.cram", "/d/x.S5.cram", "/d/cram", "/d/.cram", "/d/S6_x.cram"]
    own = spark.createDataFrame([("S1",), ("S10",), ("S3",), ("S4",), ("S5",), ("S6",), ("S6_x",), ("",)], "sample_id string")
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r["sample_id"]: r["path"] for r in files.find_file(df, own, "cram").collect()}
    assert found == {"S1": "/d/run7_S1_x.cram", "S10": "/d/S10.b.cram", "S3": None, "S4": None, "S5": "/d/x.S5.cram", "S6": None, "S6_x": "/d/S6_x.cram", "": found[""]}
    inside = {r["sample_id"]: r["path"] for r in files.find_file_contains(df, own, "cram").collect()}
    assert inside == {"S1": "/d/S10.b.cram", "S10": "/d/S10.b.cram", "S3": None, "S4": None, "S5": "/d/x.S5.cram", "S6": "/d/S6_x.cram", "S6_x": "/d/S6_x.cram", "": None}
    assert {r["path"] for r in files.find_file_contains(df, own, None).collect()} == {None}


def test_numbers_are_gapless_in_order(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(40), f"r{i}") for i in range(300)], "k int, v string").repartition(6)
    out = numbering.numbered(df, ["k"], "at")
    got = sorted((r["at"], r["k"]) for r in out.collect())
    assert out.columns == ["k", "v", "at"] and [a for a, _ in got] == list(range(300)) and [k for _, k in got] == sorted(k for _, k in got)
    assert numbering.numbered(df.where("k < 0"), ["k"], "at").collect() == []


def test_bounds_in_single_precision_lose_no_neighbor(monkeypatch):
    """Distances at the bound itself, far from the origin, of mixed sizes, and with ties, as products in double precision give them."""
    rng = np.random.default_rng(31)
    sets = [np.clip(rng.normal(size=(300, 49)), -2, 2), 1e6 + rng.normal(size=(300, 5)), rng.normal(size=(300, 3)) * 10.0 ** rng.integers(-25, 25, (300, 1)), np.round(rng.normal(size=(300, 2)))]
    for vecs in (*sets, np.zeros((300, 2))):
        a, b, ids = vecs[:120], vecs[120:], np.array([f"S{i}" for i in rng.permutation(300)])
        exact = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        bound = np.sort(exact, axis=1)[:, 6]  # the seventh nearest lies at the bound
        want = [sorted((d, n) for d, n in zip(row, ids[120:].tolist(), strict=True) if d <= limit)[:7] for row, limit in zip(exact.tolist(), bound.tolist(), strict=True)]
        monkeypatch.setattr(knn, "_products", None)  # no product in double precision is needed
        i, j, d = knn._nearest(ids[:120], a, ids[120:], b, 7, bound)
        monkeypatch.undo()
        assert [[(x, n) for x, n in zip(d[i == row].tolist(), ids[120:][j[i == row]].tolist(), strict=True)] for row in range(120)] == want
