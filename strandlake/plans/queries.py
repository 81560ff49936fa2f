"""One registered query for each operator, over the views of synth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.operators import coverage, dipcn, files, genmap, haplotype, intervals, knn, normalize, reads
from strandlake.plans import synth as S
from strandlake.sources import bam, bgzf, sinks, text
from strandlake.tables import materialize, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _round(df: DataFrame, *names: str) -> DataFrame:
    """Six places, so that the order of summation does not show."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return normalize.valid_bins(S.depth_bins(spark, d), intervals.mask_kb(S.repeat_mask(spark, d)), S.CHROM, S.START, S.END, S.MIN_DEPTH, S.MAX_DEPTH)


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return intervals.unmasked(intervals.bins_in_region(S.depth_bins(spark, d), S.CHROM, S.START, S.END), intervals.mask_kb(S.repeat_mask(spark, d)))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return normalize.region_stats(_valid(spark, d))


def _z_selected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised cells of the selected regions, these, and all valid cells. Cells and statistics are written once: each is read by
    several later steps, and none of them should count the alignments again."""
    cells = materialize(_valid(spark, d), "cells")
    stats = materialize(normalize.region_stats(cells), "stats")
    selected = materialize(normalize.selected_regions(stats, S.TOP_FRAC), "selected")
    return normalize.z_selected(normalize.z_matrix(cells, stats), selected), selected, cells


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, int, DataFrame]:
    """The vectors, how many regions they have, and all valid cells."""
    z, selected, cells = _z_selected(spark, d)
    vectors, n = knn.features(z, normalize.variance_filter(selected), S.ZMAX)
    return materialize(vectors, "vectors"), n, cells


def _neighbors(spark: SparkSession, d: str) -> DataFrame:
    vectors, n, cells = _vectors(spark, d)
    near = materialize(knn.nearest_neighbors(vectors, S.K), "near")
    return knn.with_scales(near, normalize.sample_scale(cells), n)


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return reads.count_reads(S.alignments(spark, d), S.samples(spark, d), S.READ_CHROM, S.READ_START, S.READ_END, S.FLAGS)


def _some_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of the samples of which the number is not a multiple of 7: the others count as failed."""
    return _reads(spark, d).join(S.samples(spark, d).where("idx % 7 <> 0"), "sample_id", "left_semi")


@query
def region_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.region_coverage(S.depth_bins(spark, d), S.samples(spark, d), "chr6", 20500, 41250)


@query
def regions_coverage(spark: SparkSession, d: str) -> DataFrame:
    regions = spark.range(40).select(F.format_string("r%02d", "id").alias("region"), F.lit("chr6").alias("chrom"), (F.col("id") * 1700).alias("r_start"), (F.col("id") * 1700 + 2600).alias("r_end"))
    return coverage.regions_coverage(S.depth_bins(spark, d), regions)


@query
def count_reads(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d)


@query
def count_reads_dup_flags(spark: SparkSession, d: str) -> DataFrame:
    return reads.count_reads(S.alignments(spark, d), S.samples(spark, d), S.READ_CHROM, S.READ_START, S.READ_END, [1107, 339])


@query
def region_slice(spark: SparkSession, d: str) -> DataFrame:
    return reads.region_slice(S.alignments(spark, d), "chr6", 20000, 24000)


@query
def mask_kb(spark: SparkSession, d: str) -> DataFrame:
    return intervals.mask_kb(S.repeat_mask(spark, d))


@query
def bins_in_region(spark: SparkSession, d: str) -> DataFrame:
    return intervals.bins_in_region(S.depth_bins(spark, d), S.CHROM, S.START, S.END)


@query
def bins_unmasked(spark: SparkSession, d: str) -> DataFrame:
    return _usable(spark, d)


@query
def population_mean_depth(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.population_mean_depth(_usable(spark, d)), "mean_depth")


@query
def valid_regions(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.valid_regions(normalize.population_mean_depth(_usable(spark, d)), S.MIN_DEPTH, S.MAX_DEPTH), "mean_depth")


@query
def valid_bins(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d)


@query
def sample_scale(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.sample_scale(_valid(spark, d)), "scale")


@query
def row_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.row_normalized(_valid(spark, d)), "x")


@query
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(_stats(spark, d), "mu", "var", "ratio")


@query
def median_rescale(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.median_rescale(_stats(spark, d)), "median_ratio", "c")


@query
def z_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = _valid(spark, d)
    return _round(normalize.z_matrix(cells, normalize.region_stats(cells)), "z")


@query
def selected_regions(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.selected_regions(_stats(spark, d), S.TOP_FRAC), "mu", "var", "ratio")


@query
def z_selected(spark: SparkSession, d: str) -> DataFrame:
    return _round(_z_selected(spark, d)[0], "z")


@query
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    return normalize.matrix_pivot(S.depth_bins(spark, d), [10000, 20000, 30000, 40000, 50000])


@query
def clip_impute(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with every selected region, missing as 0."""
    z, selected, _ = _z_selected(spark, d)
    regions = selected.agg(F.collect_list(F.struct("start", "end"))).scalar()
    cells = z.select("sample_id").distinct().select("sample_id", F.explode(regions).alias("r")).select("sample_id", "r.start", "r.end").join(z, ["sample_id", "start", "end"], "left")
    return _round(cells.select("sample_id", "start", "end", C.clip(F.col("z"), S.ZMAX).alias("f")), "f")


@query
def variance_filter(spark: SparkSession, d: str) -> DataFrame:
    stats = materialize(_stats(spark, d), "stats")
    limit = stats.agg(F.max("ratio")).first()[0]
    return _round(normalize.variance_filter(stats, sigma2_max=round(limit * 0.9, 3)).select("start", "end", "ratio"), "ratio")


@query
def variance_filter_frac(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.variance_filter(_stats(spark, d), frac_r=0.5).select("start", "end", "ratio"), "ratio")


@query
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each sample and the one after it."""
    vectors, _, _ = _vectors(spark, d)
    pairs = S.samples(spark, d).select(F.col("sample_id").alias("a"), F.format_string("S%05d", F.col("idx") + 1).alias("b"))
    return _round(knn.pairwise_distance(vectors, pairs), "sq_dist")


@query
def nearest_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return _round(_neighbors(spark, d), "scale", "nbr_scale", "sq_dist", "norm_dist")


@query
def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    return _round(knn.nearest_neighbors(vectors, 5, "vec_id", "embedding"), "sq_dist")


@query
def diploid_cn(spark: SparkSession, d: str) -> DataFrame:
    return _round(dipcn.diploid_cn(_neighbors(spark, d), _reads(spark, d), 10), "dip_cn")


@query
def missing_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return dipcn.missing_neighbors(_neighbors(spark, d), _some_reads(spark, d))


def _exon(kind: str) -> Query:
    return lambda spark, d: _round(dipcn.exon_cn(S.exon_counts(spark, d), _neighbors(spark, d), kind, 10), "dip_cn")


EXONS = {"exon_cn_1a": "1A", "exon_cn_1b": "1B", "exon_cn_1b_kiv3": "1B_KIV3", "exon_cn_1b_notkiv3": "1B_notKIV3"}
REGISTRY.update({name: _exon(kind) for name, kind in EXONS.items()})


@query
def normalize_sample_id(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*(F.lit(t) for t in ("", ".cram", ".bam", ".b38.irc.v1_subset.cram", " "))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    raw = F.concat(F.lit("  "), F.col("s_name"), tail)
    return S.table(spark, d, "supplier").select("s_suppkey", C.normalize_sample_id(raw).alias("sample_id"), C.norm_chrom(F.when(F.col("s_suppkey") % 2 == 0, "6").otherwise("chr6")).alias("chrom"))


@query
def sample_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dipcn.sample_overlap(S.exon_counts(spark, d), _some_reads(spark, d))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """One alignment file for most samples, with an index of one of two names or none."""
    s = S.samples(spark, d).where("idx % 9 <> 0")
    base = F.concat(F.lit("/data/"), F.col("sample_id"), F.lit("_v1_x"))
    index = F.when(F.col("idx") % 4 == 1, F.concat(base, F.lit(".cram.crai"))).when(F.col("idx") % 4 == 2, F.concat(base, F.lit(".crai")))
    return s.select(F.explode(F.array_compact(F.array(F.concat(base, F.lit(".cram")), index))).alias("path"))


@query
def find_file_contains(spark: SparkSession, d: str) -> DataFrame:
    """Files named after a run and a sample; short names of samples are in files of longer ones too."""
    own = S.samples(spark, d)
    names = own.select("sample_id").unionByName(own.select(F.concat(F.lit("S"), F.col("idx").cast("string")).alias("sample_id"))).unionByName(own.select(F.format_string("%03d", F.col("idx") % 1000).alias("sample_id"))).distinct()
    paths = own.select(F.concat(F.lit("/data/run"), (F.col("idx") % 7).cast("string"), F.when(F.col("idx") % 2 == 0, "_").otherwise("-S"), F.col("idx").cast("string"), F.lit("."), "sample_id", F.when(F.col("idx") % 5 == 0, ".bam").otherwise("_x.cram")).alias("path"))
    return files.find_file_contains(paths, names, "cram")


@query
def file_status(spark: SparkSession, d: str) -> DataFrame:
    return files.file_status(S.samples(spark, d), _listing(spark, d), "cram")


@query
def file_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return files.status_counts(files.file_status(S.samples(spark, d), _listing(spark, d), "cram"))


@query
def accounting(spark: SparkSession, d: str) -> DataFrame:
    own = S.samples(spark, d)
    return files.accounting(own, own.where("idx % 3 = 0"), own.where("idx % 3 = 1 and idx % 2 = 0"))


@query
def longest_prefix_sample(spark: SparkSession, d: str) -> DataFrame:
    """Samples are S00001 and S00001_v1 and so on; the longer name wins where it is known."""
    own = S.samples(spark, d)
    known = own.select("sample_id").unionByName(own.where("idx % 3 = 0").select(F.concat("sample_id", F.lit("_v1")).alias("sample_id")))
    return files.longest_prefix_sample(_listing(spark, d), known)


@query
def locus_lookup(spark: SparkSession, d: str) -> DataFrame:
    loci = S.table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_brand").alias("name"), F.lit("chr6").alias("chrom"), (F.col("p_partkey") * 1000).alias("start"), (F.col("p_partkey") * 1000 + 501).alias("end"))
    return files.locus_lookup(loci, "Brand#17")


@query
def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("line_no"), "l_quantity")
    return normalize.last_wins(lines, ["l_suppkey"], "line_no", ["l_quantity"])


@query
def lenient_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.format_string("S%05d", F.col("o_custkey") % 500).alias("sample_id"), F.when(F.col("o_orderkey") % 5 == 0, "Error").when(F.col("o_orderkey") % 7 == 0, "nan").otherwise(F.col("o_custkey").cast("string")).alias("value"))
    return files.parse_counts(raw)


@query
def ibs_edges(spark: SparkSession, d: str) -> DataFrame:
    return haplotype.ibs_edges(S.ibs(spark, d), S.samples(spark, d))


@query
def ibd_edges(spark: SparkSession, d: str) -> DataFrame:
    return haplotype.ibd_edges(S.ibd(spark, d), S.samples(spark, d), 900_000, 1_100_000)


@query
def ibd_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _round(haplotype.ibd_edges(S.ibd(spark, d), S.samples(spark, d), 900_000, 1_100_000, weighted=True, drop_self=True), "w")


@query
def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    return S.ibd(spark, d).groupBy(C.segment_distance(F.col("bp1"), F.col("bp2"), 900_000, 1_100_000).alias("distance")).agg(F.count(F.lit(1)).alias("segments"))


@query
def adjacency_list(spark: SparkSession, d: str) -> DataFrame:
    lists = haplotype.adjacency_list(haplotype.ibs_edges(S.ibs(spark, d), S.samples(spark, d)))
    return lists.select("node", "degree", F.array_join("nbrs", ",").alias("nbrs"))


def _phasing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Where phasing starts, and its edges. Both are written once: rounds and what follows them read them several times."""
    edges = materialize(haplotype.ibs_edges(S.ibs(spark, d), S.samples(spark, d)), "edges")
    return materialize(haplotype.phase_init(S.irr(spark, d), edges), "start"), edges


@query
def phase_init(spark: SparkSession, d: str) -> DataFrame:
    return _round(_phasing(spark, d)[0], "irr", "h0", "h1")


@query
def phase_jacobi_3(spark: SparkSession, d: str) -> DataFrame:
    return _round(haplotype.phase_jacobi(*_phasing(spark, d), 3), "irr", "h0", "h1")


@query
def phase_gauss_seidel(spark: SparkSession, d: str) -> DataFrame:
    return _round(haplotype.phase_gauss_seidel(*_phasing(spark, d), 4), "irr", "h0", "h1")


@query
def haplotype_output(spark: SparkSession, d: str) -> DataFrame:
    state, edges = _phasing(spark, d)
    out = haplotype.haplotype_output(haplotype.phase_gauss_seidel(state, edges, 4), edges, S.samples(spark, d))
    return _round(out, "irrs", "hap1phased", "hap2phased", "hap1imp", "hap2imp")


@query
def genetic_map_interp(spark: SparkSession, d: str) -> DataFrame:
    return _round(genmap.interpolate(S.map_queries(spark, d), S.genetic_map(spark, d)), "cm")


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    near, counts = materialize(_neighbors(spark, d), "neighbors"), materialize(S.exon_counts(spark, d), "exons")
    a, b = (dipcn.exon_cn(counts, near, kind, 10).withColumnRenamed("dip_cn", "cn") for kind in ("1A", "1B"))
    return dipcn.cn_estimate(a, b)


@query
def cn_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _round(_estimates(spark, d), "dip_estimate", "hap_estimate")


@query
def cn_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(dipcn.cn_summary(_estimates(spark, d)), "mean", "median", "std", "least", "most")


@query
def binned_depth(spark: SparkSession, d: str) -> DataFrame:
    return _round(coverage.binned_depth(S.alignments(spark, d), 150, 1000, "chr6", 100_000), "depth")


@query
def event_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A second, sparse depth matrix: users by days."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    cells = S.table(spark, d, "events").groupBy(F.format_string("U%05d", "user_id").alias("sample_id"), day.alias("start")).agg(F.sum("value").alias("depth"))
    return _round(normalize.region_stats(cells.withColumn("end", F.col("start") + 1)), "mu", "var", "ratio")


def _text(df: DataFrame, line: F.Column, head: str | None = None, tail: str | None = None) -> str:
    """The path of text lines written to the shared folder, one for each row, with a line before or after all of them."""
    path = f"{shared_folder(df.sparkSession)}/lines"
    one = lambda v: df.sparkSession.range(1).select(F.lit(v).alias("value")).coalesce(1)
    lines = df.select(line.alias("value"))
    # A union keeps the order of partitions, each of which is a file: the first one has the head alone.
    lines = one(head).unionByName(lines) if head is not None else lines
    (lines.unionByName(one(tail)) if tail is not None else lines).write.text(path)
    return path


def _written(spark: SparkSession, write: Callable[[str], None]) -> str:
    path = f"{shared_folder(spark)}/out"
    write(path)
    return path


def _tabs(*columns: F.Column) -> F.Column:
    return F.concat_ws("\t", *(c.cast("string") for c in columns))


@query
def slices_written(spark: SparkSession, d: str) -> DataFrame:
    """Slices of all samples from position-ordered Parquet, one folder for each sample, read again."""
    indexed = spark.read.parquet(_written(spark, lambda p: reads.write_indexed(S.alignments(spark, d), p, 8)))
    back = spark.read.parquet(_written(spark, lambda p: reads.write_slices(indexed, p, "chr6", 20000, 24000)))
    return back.select(S.alignments(spark, d).columns)


@query
def reads_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples with number 0 modulo 5 have no alignments here; of those some have a file, which counts as unreadable."""
    own = S.samples(spark, d)
    aln = S.alignments(spark, d).join(own.where("idx % 5 <> 0"), "sample_id", "left_semi")
    found = files.find_file(_listing(spark, d), own, "cram")
    return reads.count_reads_of_files(aln, own, found, S.READ_CHROM, S.READ_START, S.READ_END, S.FLAGS)


@query
def sam_alignments(spark: SparkSession, d: str) -> DataFrame:
    own = S.alignments(spark, d).where("chrom = 'chr7'")
    size = F.col("end") - F.col("pos")
    cigar = F.concat(F.lit("5S40M3I10D"), (size - 60).cast("string"), F.lit("M"), F.lit("10N"))
    line = _tabs(F.lit("r"), F.col("flag"), F.col("chrom"), F.col("pos") + 1, F.col("mapq"), cigar, F.when(F.col("next_chrom") == F.col("chrom"), "=").otherwise(F.col("next_chrom")))
    return text.read_sam(spark, _text(own, line, "@HD\tVN:1.6"), "one").select(own.columns)


#: Names and lengths of the references of the alignments' BAM files.
REFERENCES = {"chr5": 101_000, "chr6": 101_000, "chr7": 101_000, "chrX": 101_000}


@query
def bam_region(spark: SparkSession, d: str) -> DataFrame:
    """All alignments as BAM files with an index, and a region of them read back by way of it."""
    path = _written(spark, lambda p: bam.write_bam(S.alignments(spark, d), p, REFERENCES))
    return bam.read_bam(spark, path, ("chr6", 20000, 24000)).select(S.alignments(spark, d).columns)


@query
def bam_counts(spark: SparkSession, d: str) -> DataFrame:
    """Filtered read counts from BAM files, read whole and in splits."""
    path = _written(spark, lambda p: bam.write_bam(S.alignments(spark, d), p, REFERENCES))
    own = bam.read_bam(spark, path, split_bytes=1 << 16)
    return reads.count_reads(own, S.samples(spark, d), S.READ_CHROM, S.READ_START, S.READ_END, S.FLAGS)


@query
def bam_depth(spark: SparkSession, d: str) -> DataFrame:
    """Binned depth of the covered blocks of alignments from BAM files: deletions and skips leave holes."""
    cigar = F.concat(F.lit("5S40M3I10D"), (F.col("end") - F.col("pos") - 60).cast("string"), F.lit("M10N"))
    path = _written(spark, lambda p: bam.write_bam(S.alignments(spark, d).withColumn("cigar", cigar), p, REFERENCES))
    lengths = spark.createDataFrame([(c, n - 500) for c, n in REFERENCES.items() if c != "chrX"], "chrom string, length long")
    return _round(coverage.binned_depth_by_blocks(bam.read_bam(spark, path), S.samples(spark, d), 1000, lengths, 8000), "depth")


@query
def depth_read(spark: SparkSession, d: str) -> DataFrame:
    """Depth files as blocked gzip, one for each sample, read in splits that do not end where lines do."""
    bins = S.depth_bins(spark, d)
    line = _tabs(*(F.col(c) for c in ("chrom", "start", "end", "depth")))
    rows = bins.select(F.concat("sample_id", F.lit(".regions.bed.gz")).alias("name"), line.alias("value"), "start")
    path = _written(spark, lambda p: bgzf.write_lines(rows, p, ["start"]))
    return text.read_depth(spark, path, S.samples(spark, d), split_bytes=1 << 12)


@query
def sample_list(spark: SparkSession, d: str) -> DataFrame:
    own = S.samples(spark, d).orderBy("idx").coalesce(1)
    path = _written(spark, lambda p: own.select(F.concat(F.lit(" "), "sample_id", F.lit("\n  "))).write.text(p))
    return text.read_samples(spark, path)


@query
def mask_read(spark: SparkSession, d: str) -> DataFrame:
    line = _tabs(F.col("chrom"), F.col("start"), F.col("end"), F.lit("x"))
    return text.read_mask(spark, _text(S.repeat_mask(spark, d), line, "# a comment", "chr6\t1"))


def _matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    z, selected, cells = _z_selected(spark, d)
    scales = normalize.sample_scale(cells)
    return text.read_normalized(spark, _written(spark, lambda p: sinks.write_normalized(selected, scales, z, p)))


@query
def matrix_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)[0]


@query
def matrix_scales(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)[1]


@query
def matrix_cells(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)[2].withColumn("z", F.col("z") + 0.0)


@query
def neighbors_read(spark: SparkSession, d: str) -> DataFrame:
    return text.read_neighbors(spark, _written(spark, lambda p: sinks.write_neighbors(_neighbors(spark, d), p)))


@query
def counts_read(spark: SparkSession, d: str) -> DataFrame:
    """A null count is written as Error, which the reader drops."""
    some = _reads(spark, d).join(S.samples(spark, d), "sample_id").select("sample_id", F.when(F.col("idx") % 5 != 0, F.col("reads")).alias("reads"))
    return text.read_counts(spark, _written(spark, lambda p: sinks.write_counts(some, p, S.READ_CHROM, S.READ_START, S.READ_END)))


@query
def exon_counts_read(spark: SparkSession, d: str) -> DataFrame:
    line = _tabs(F.concat("sample_id", F.lit(".cram")), *(F.col(c) for c in ("kiv3", "kiv2", "tied", "exon1a")))
    return text.read_exon_counts(spark, _text(S.exon_counts(spark, d), line, tail="badline"))


@query
def exon_dipcn_read(spark: SparkSession, d: str) -> DataFrame:
    cn = dipcn.exon_cn(S.exon_counts(spark, d), _neighbors(spark, d), "1A", 10)
    return text.read_dipcn(spark, _written(spark, lambda p: sinks.write_exon_dipcn(cn, p))).select("sample_id", "irr")


@query
def dipcn_read(spark: SparkSession, d: str) -> DataFrame:
    """The same file with the numbers of its lines, which are those of the samples in order."""
    cn = dipcn.exon_cn(S.exon_counts(spark, d), _neighbors(spark, d), "1B", 10)
    return text.read_dipcn(spark, _written(spark, lambda p: sinks.write_exon_dipcn(cn, p)))


@query
def ibs_read(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem")
    line = _tabs(F.format_string("S%05d", "l_suppkey"), F.col("l_linenumber") % 2 + 1, F.lit(0), F.lit(1.5), F.lit(0.1), F.format_string("S%05d", F.col("l_partkey") % 90), F.col("l_orderkey") % 2 + 1)
    return text.read_ibs(spark, _text(lines, line, "ID\thap\tnbrInd\tcMlen\tcMedge\tIDnbr\thapNbr")).drop("line_no")


@query
def ibd_read(spark: SparkSession, d: str) -> DataFrame:
    at = F.col
    line = _tabs(at("id1"), at("hap1"), at("id2"), at("hap2"), F.lit(6), at("bp1"), at("bp2"), F.lit("x"), F.lit("y"), F.round("length", 6), F.round("match", 6))
    return text.read_ibd(spark, _text(S.ibd(spark, d), line)).drop("line_no")


@query
def genetic_map_read(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("position").cast("string"), F.lit("0.5"), F.round("cm", 6).cast("string"))
    return text.read_genetic_map(spark, _text(S.genetic_map(spark, d), line, "position rate Genetic_Map(cM)"))


@query
def map_written(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    chrom = F.when(key % 3 == 0, "chr16").when(key % 2 == 0, "6").otherwise("chr6")
    rows = S.table(spark, d, "part").select(chrom.alias("chr"), F.concat(F.lit("rs"), key).alias("snp"), (key / 8).alias("cm"), (key * 100).alias("bp"))
    return text.map_of_chromosome(text.read_map(spark, _written(spark, lambda p: sinks.write_map(rows, p))), "chr6")


@query
def loci_read(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("p_partkey") * 1000
    line = _tabs(F.lit("chr6"), start, start + 501, F.lit("."), F.lit("."), F.lit("+"), F.col("p_brand"))
    return text.read_loci(spark, _text(S.table(spark, d, "part"), line)).drop("line_no")


@query
def panel_read(spark: SparkSession, d: str) -> DataFrame:
    line = _tabs(F.format_string("S%05d", "s_suppkey"), F.format_string("P%d", "s_nationkey"), F.lit("x"))
    return text.read_panel(spark, _text(S.table(spark, d, "supplier"), line, "sample\tpop"))


@query
def haplotypes_written(spark: SparkSession, d: str) -> DataFrame:
    state, edges = _phasing(spark, d)
    out = haplotype.haplotype_output(haplotype.phase_gauss_seidel(state, edges, 4), edges, S.samples(spark, d))
    return spark.read.option("sep", "\t").option("header", True).csv(_written(spark, lambda p: sinks.write_haplotypes(out, p)))


@query
def extreme_columns(spark: SparkSession, d: str) -> DataFrame:
    stats = materialize(_stats(spark, d), "stats")
    return normalize.extreme_columns(stats, stats.agg(F.median("ratio")).first()[0])


@query
def phasable(spark: SparkSession, d: str) -> DataFrame:
    return _round(haplotype.phasable(*_phasing(spark, d)), "mean_irr", "mean_degree")


@query
def read_totals(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).agg(F.count(F.lit(1)).alias("samples"), F.sum("reads").alias("reads"))


flagship = diploid_cn
