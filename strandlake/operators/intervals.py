"""Intervals: masks, bins in a region, and overlap joins by way of equal kilobase cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.columns import kb, norm_chrom, overlap


def mask_kb(mask: DataFrame) -> DataFrame:
    """(chrom, kb): all cells that a mask's intervals touch, both ends included."""
    cells = F.explode(F.sequence(kb(F.col("start")), kb(F.col("end"))))
    return mask.where("start <= end").select(norm_chrom(F.col("chrom")).alias("chrom"), cells.alias("kb")).distinct()


def bins_in_region(bins: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bins with depth on the chromosome that touch the region, ends included; without bounds, all of it."""
    kept = bins.where((norm_chrom(F.col("chrom")) == norm_chrom(F.lit(chrom))) & (F.col("depth") > 0))
    return kept if start is None or end is None else kept.where((F.col("end") >= start) & (F.col("start") <= end))


def unmasked(bins: DataFrame, cells: DataFrame) -> DataFrame:
    """Bins of which no cell (both ends included) is masked. Distinct bins are tested, not every sample's."""
    places = bins.select(norm_chrom(F.col("chrom")).alias("c"), "start", "end").distinct()
    touched = places.withColumn("kb", F.explode(F.sequence(kb(F.col("start")), kb(F.col("end")))))
    hit = touched.join(cells.select(F.col("chrom").alias("c"), "kb"), ["c", "kb"], "left_semi").select("c", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    return bins.join(hit, (norm_chrom(F.col("chrom")) == F.col("c")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), "left_anti")


def overlap_join(bins: DataFrame, regions: DataFrame, cell: int = 1_000_000) -> DataFrame:
    """Bins with every region(region, chrom, r_start, r_end) they overlap (half-open) and the shared length.

    Both sides are spread over cells of equal size and met by equality; a pair is kept in the first cell they share, so
    no duplicates need to be removed.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    left = bins.where("start < end").withColumn("cell", F.explode(F.sequence(at("start"), F.floor((F.col("end") - 1) / cell))))
    right = regions.where("r_start < r_end").withColumn("cell", F.explode(F.sequence(at("r_start"), F.floor((F.col("r_end") - 1) / cell))))
    met = left.join(right.withColumnRenamed("chrom", "r_chrom"), (F.col("chrom") == F.col("r_chrom")) & (left["cell"] == right["cell"]))
    shared = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    once = left["cell"] == F.greatest(at("start"), at("r_start"))
    return met.where(once).withColumn("overlap", shared).where("overlap > 0").drop("cell", "r_chrom")
