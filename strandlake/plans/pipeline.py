"""The seven steps over files. Between steps tables are Parquet in the output folder, so a failed run goes on from them."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.operators import coverage, dipcn, files, haplotype, intervals, knn, normalize, numbering, reads
from strandlake.sources import bam, sinks, text

log = logging.getLogger(__name__)


class Pipeline:
    """run(spark) takes the enabled steps in order; a step's failure ends the run, or with fail_fast=False is logged."""

    def __init__(self, config: Config, fail_fast: bool = True) -> None:
        self.config, self.fail_fast = config, fail_fast
        self.v = config.values

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        steps = {
            "index": self.index, "count_reads": self.count_reads, "mosdepth": self.depth, "normalize": self.normalize,
            "neighbors": self.neighbors, "compute_diploid_genotypes": self.diploid, "compute_haploid_genotypes": self.haploid,
            "exon_genotypes": self.exons,
        }
        done: dict[str, DataFrame] = {}
        for name in self.config.unknown():
            log.warning("%s is not known and has no effect", name)
        for name, step in steps.items():
            if not self.config.enabled(name):
                continue
            began = time.monotonic()
            try:
                done[name] = step(spark)
                log.info("step %s took %.1f s", name, time.monotonic() - began)
            except Exception:
                if self.fail_fast:
                    raise
                log.exception("step %s failed", name)
        if self.config.step("mosdepth").get("remove_intermediate"):
            done = {}
            self.remove_tables(spark)
        return done

    def _out(self, step: str) -> str:
        return f"{self.v.get('output_dir', '.')}/{self.config.step(step).get('output_file_prefix', step)}"

    def _kept(self, spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.v.get('output_dir', '.')}/tables/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.v.get('output_dir', '.')}/tables/{name}")

    def _samples(self, spark: SparkSession) -> DataFrame:
        return text.read_samples(spark, self.v["samples_file"]).select("sample_id").distinct()

    def remove_tables(self, spark: SparkSession) -> None:
        """Deletes the tables between steps, by Spark's own file system."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.v.get('output_dir', '.')}/tables")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def index(self, spark: SparkSession) -> DataFrame:
        status = files.file_status(self._samples(spark), text.list_files(spark, self.v["directory_loc"]), self.v["file_type"])
        sinks.write_table(status, self._out("index"))
        return status

    def count_reads(self, spark: SparkSession) -> DataFrame:
        """Alignments are BAM files in directory_loc where that is the file type and no table of alignments is named: of each
        the region is read by its index, a damaged one is `Error`. Else they are Parquet, by default directory_loc/alignments;
        then a sample with a file but without alignments is `Error`. Samples without either are left out."""
        own = self.config.step("count_reads")
        region = (self.v["chrom"], self.v["start_bp"], self.v["end_bp"])
        samples = self._samples(spark)
        found = files.find_file(text.list_files(spark, self.v["directory_loc"]), samples, self.v["file_type"])
        if str(self.v["file_type"]).lower() == "bam" and not own.get("alignments"):
            # Several files of one sample are parts of it; names of files lead to samples as in find_file.
            owner = files.longest_prefix_sample(text.list_files(spark, self.v["directory_loc"]).where("path like '%.bam'"), samples).unionByName(found.where("path is not null").select("path", "sample_id"))
            names = owner.select(files.stem(F.col("path")).alias("stem"), F.col("sample_id").alias("owner")).distinct()
            aln = bam.read_bam(spark, self.v["directory_loc"], region, mark_broken=True).join(names, F.col("sample_id") == F.col("stem")).withColumn("sample_id", F.col("owner"))
            counts = reads.count_reads_of_files(aln, samples, found, *region, self.config.flags(), own["min_mapq"], empty=0)
        else:
            aln = text.read_alignments(spark, own.get("alignments", f"{self.v['directory_loc']}/alignments"))
            counts = reads.count_reads_of_files(aln, samples, found, *region, self.config.flags(), own["min_mapq"])
        counts = self._kept(spark, counts, "read_counts_all")
        sinks.write_counts(counts, self._out("count_reads"), *region, self.v.get("output_file_type", "tsv"))
        counts = self._kept(spark, counts.where("reads is not null"), "read_counts")
        self.totals = counts.agg(F.count(F.lit(1)).alias("samples"), F.sum("reads").alias("reads")).first().asDict()
        log.info("counted %(reads)s reads of %(samples)s samples", self.totals)
        return counts

    def _bins(self, spark: SparkSession) -> DataFrame:
        return text.read_depth(spark, self.config.step("mosdepth")["work_dir"], self._samples(spark))

    def depth(self, spark: SparkSession) -> DataFrame:
        out = coverage.region_coverage(self._bins(spark), self._samples(spark), self.v["chrom"], self.v["start_bp"], self.v["end_bp"])
        sinks.write_table(out, self._out("mosdepth"), self.v.get("output_file_type", "tsv"))
        return out

    def normalize(self, spark: SparkSession) -> DataFrame:
        own = self.config.step("normalize")
        cells = intervals.mask_kb(text.read_mask(spark, own["repeat_mask_file"]))
        bounds = (self.v.get("start_bp"), self.v.get("end_bp")) if own["scope"] == "region" else (None, None)
        valid = self._kept(spark, normalize.valid_bins(self._bins(spark), cells, self.v["chrom"], *bounds, own["min_depth"], own["max_depth"]), "valid_bins")
        stats = self._kept(spark, normalize.region_stats(valid), "region_stats")
        scales = self._kept(spark, normalize.sample_scale(valid), "scales")
        selected = self._kept(spark, normalize.selected_regions(stats, own["top_frac"]), "selected")
        z = self._kept(spark, normalize.z_selected(normalize.z_matrix(valid, stats), selected), "z")
        sinks.write_normalized(selected, scales, z, self._out("normalize"))
        return z

    def neighbors(self, spark: SparkSession) -> DataFrame:
        own = self.config.step("neighbors")
        kept = normalize.variance_filter(self._table(spark, "selected"), own["sigma2_max"], own["frac_r"])
        vectors, n = knn.features(self._table(spark, "z"), kept, own["zmax"])
        near = knn.with_scales(knn.nearest_neighbors(self._kept(spark, vectors, "vectors"), own["num_neighbors"]), self._table(spark, "scales"), n)
        near = self._kept(spark, near, "neighbors")
        sinks.write_neighbors(near, self._out("neighbors"))
        return near

    def diploid(self, spark: SparkSession) -> DataFrame:
        own = self.config.step("compute_diploid_genotypes")
        near, counts = self._table(spark, "neighbors"), self._table(spark, "read_counts")
        if dipcn.sample_overlap(counts, near).isEmpty():
            raise ValueError("no sample has both read counts and neighbours")
        dip = self._kept(spark, dipcn.diploid_cn(near, counts, own["n_nbr"]), "dipcn")
        sinks.write_dipcn(dip, self._out("compute_diploid_genotypes"), self.v.get("output_file_type", "tsv"))
        return dip

    def haploid(self, spark: SparkSession) -> DataFrame:
        own = self.config.step("compute_haploid_genotypes")
        dip = self._table(spark, "dipcn")
        names = self._kept(spark, numbering.numbered(dip.select("sample_id", F.col("dip_cn").alias("irr")), ["sample_id"], "idx"), "names")
        method = str(own["method"]).lower()
        if method == "ibs":
            edges = haplotype.ibs_edges(text.read_ibs(spark, own["neighbor_file"]), names, own["max_neighbors"])
        elif method == "ibd":
            edges = haplotype.ibd_edges(
                text.read_ibd(spark, own["neighbor_file"]), names, self.v["start_bp"], self.v["end_bp"], own["max_neighbors"], own["min_length"],
                own["min_match"], own["weighted"], own["weight_scale"])
        else:
            raise ValueError(f"unknown method {method}; known: ibs, ibd")
        out = haplotype.haplotype_cn(names, self._kept(spark, edges, "edges"), names, own["min_neighbors"], own["n_iters"], own["iteration"])
        sinks.write_haplotypes(out, self._out("compute_haploid_genotypes"))
        return out

    def exons(self, spark: SparkSession) -> DataFrame:
        """Copy numbers of the exon types, and the estimate and its summary from them."""
        own = self.config.step("exon_genotypes")
        near, counts = self._table(spark, "neighbors"), self._kept(spark, text.read_exon_counts(spark, own["exon_counts_file"]), "exon_counts")
        if dipcn.sample_overlap(counts, near).isEmpty():
            raise ValueError("no sample has both exon counts and neighbours")
        cn = {}
        for kind in ("1A", "1B", "1B_KIV3", "1B_notKIV3"):
            cn[kind] = self._kept(spark, dipcn.exon_cn(counts, near, kind, own["n_nbr"]), f"exon_{kind}")
            sinks.write_exon_dipcn(cn[kind], f"{self._out('exon_genotypes')}.{kind}")
        estimate = dipcn.cn_estimate(*(cn[k].withColumnRenamed("dip_cn", "cn") for k in ("1A", "1B")))
        estimate = self._kept(spark, estimate, "estimate")
        kind = self.v.get("output_file_type", "tsv")
        sinks.write_table(estimate, f"{self._out('exon_genotypes')}.estimate", kind)
        sinks.write_table(dipcn.cn_summary(estimate), f"{self._out('exon_genotypes')}.summary", kind)
        return estimate
