"""Filtered read counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.columns import reads_pass


def count_reads(alignments: DataFrame, samples: DataFrame, chrom: str, start: int, end: int, flags: list[int], min_mapq: int = 1) -> DataFrame:
    """(sample_id, reads long): passing reads of each sample, 0 without any. The filter reaches the Parquet scan; counts
    are summed before the shuffle, so a sample with most of the reads costs one row for each task."""
    passing = alignments.where(reads_pass(flags, min_mapq, chrom, start, end)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("reads"))
    return samples.select("sample_id").join(passing, "sample_id", "left").select("sample_id", F.coalesce("reads", F.lit(0).cast("long")).alias("reads"))


def count_reads_of_files(alignments: DataFrame, samples: DataFrame, files: DataFrame, chrom: str, start: int, end: int, flags: list[int], min_mapq: int = 1, empty: int | None = None) -> DataFrame:
    """(sample_id, reads long): as count_reads, for the samples that have alignments; null for those with a row without a
    flag, the mark of a file that could not be read; `empty` for those that have a file in files(sample_id, path) but no
    row: null where a table of alignments does not tell why, 0 where the reader marks what it cannot read. Samples with
    neither have no row. One pass counts the passing reads and tells which samples have any."""
    sound = F.count_if(F.coalesce(reads_pass(flags, min_mapq, chrom, start, end), F.lit(False)))
    counted = alignments.groupBy("sample_id").agg(F.when(F.count_if(F.col("flag").isNull()) == 0, sound).alias("reads"), F.lit(True).alias("counted"))
    listed = files.where("path is not null").select("sample_id").distinct().withColumn("listed", F.lit(True))
    known = samples.select("sample_id").distinct().join(counted, "sample_id", "left").join(listed, "sample_id", "left")
    return known.where("counted or listed").select("sample_id", F.when(F.col("counted"), F.col("reads")).otherwise(F.lit(empty).cast("long")).alias("reads"))


def region_slice(alignments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The alignments that overlap a half-open region, all columns: those of which the column `end`, the place after the
    last covered one, lies beyond the start. Without that column each is taken to cover one place."""
    last = F.col("end") if "end" in alignments.columns else F.col("pos") + 1
    return alignments.where((F.col("chrom") == chrom) & (last > start) & (F.col("pos") < end))


def write_slices(alignments: DataFrame, path: str, chrom: str, start: int, end: int) -> None:
    """Slices of all samples at once, one folder for each. Samples are dealt to tasks first: a region lies in one or two of the
    ranges of an ordered table, of which the tasks would else write the folders of all samples."""
    region_slice(alignments, chrom, start, end).repartition("sample_id").write.mode("overwrite").partitionBy("sample_id").parquet(path)


def write_indexed(alignments: DataFrame, path: str, partitions: int = 64) -> None:
    """Parquet ordered by (chrom, pos), so that row-group statistics serve as the index of a region scan."""
    alignments.repartitionByRange(partitions, "chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").parquet(path)
