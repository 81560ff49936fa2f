"""Depth of regions, and binned depth from alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from strandlake.functions.columns import covered_blocks, half_even, overlap
from strandlake.operators.intervals import overlap_join


def region_coverage(bins: DataFrame, samples: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(sample_id, coverage long): mean depth weighted by overlap, times 100, rounded half to even; 0 if uncovered."""
    shared = overlap(F.col("start"), F.col("end"), start, end)
    hit = bins.where(F.col("chrom") == chrom).withColumn("ov", shared).where("ov > 0")
    mean = hit.groupBy("sample_id").agg((F.sum(F.col("depth") * F.col("ov")) / F.sum("ov")).alias("mean"))
    joined = samples.select("sample_id").join(mean, "sample_id", "left")
    return joined.select("sample_id", F.coalesce(half_even(F.col("mean") * 100), F.lit(0).cast("long")).alias("coverage"))


def regions_coverage(bins: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample_id, region, coverage long) for many regions at once; pairs without overlap have no row."""
    hit = overlap_join(bins, regions)
    return hit.groupBy("sample_id", "region").agg(half_even(F.sum(F.col("depth") * F.col("overlap")) / F.sum("overlap") * 100).alias("coverage"))


def binned_depth(alignments: DataFrame, read_length: int, bin_size: int, chrom: str, length: int) -> DataFrame:
    """(sample_id, chrom, start, end, depth): mean depth of fixed bins from reads of one length, bins without reads as 0."""
    reads = alignments.where((F.col("chrom") == chrom) & (F.col("pos") >= 0) & (F.col("pos") < length)).select("sample_id", "pos", F.least(F.col("pos") + read_length, F.lit(length)).alias("stop"))
    spread = reads.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / bin_size), F.floor((F.col("stop") - 1) / bin_size))))
    covered = spread.groupBy("sample_id", "bin").agg(F.sum(F.least("stop", (F.col("bin") + 1) * bin_size) - F.greatest("pos", F.col("bin") * bin_size)).alias("bp"))
    last = F.lit((length - 1) // bin_size).cast("long")
    every = alignments.select("sample_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start, end = F.col("bin") * bin_size, F.least((F.col("bin") + 1) * bin_size, F.lit(length).cast("long"))
    joined = every.join(covered, ["sample_id", "bin"], "left")
    return joined.select("sample_id", F.lit(chrom).alias("chrom"), start.alias("start"), end.alias("end"), (F.coalesce("bp", F.lit(0).cast("long")) / (end - start)).alias("depth"))


def binned_depth_by_blocks(alignments: DataFrame, samples: DataFrame, bin_size: int, lengths: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """(sample_id, chrom, start, end, depth): mean depth of fixed bins of every sample, bins without reads as 0.

    alignments(sample_id, chrom, pos, cigar); lengths(chrom, length). Only places under M, = and X are covered: deletions
    and skips leave holes, insertions and clips cover nothing. What reaches beyond a chromosome's ends is cut off; reads
    without a position, with an unknown chromosome or a CIGAR that covers nothing count nowhere.

    Each edge of a covered block is an event of +1 or -1. Events are summed by bin before the shuffle, so that a bin is one
    row for each task however deep it is: those in a bin by how much of it they leave, and all of them for the depth that
    goes on into later bins. That running sum has two levels, within cells of bins and over the cells of a chromosome, so
    no task has more than a cell's bins or a chromosome's cells of one sample.
    """
    known = F.broadcast(lengths.select("chrom", F.col("length").cast("long").alias("length")))
    each = alignments.where("pos >= 0").join(known, "chrom").select("sample_id", "chrom", "length", F.explode(covered_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    block = each.select("sample_id", "chrom", F.least("b.start", "length").alias("a"), F.least("b.end", "length").alias("b")).where("a < b")
    edges = block.select("sample_id", "chrom", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = edges.select("sample_id", "chrom", F.col("e.at").alias("at"), F.col("e.d").alias("d"))
    at_bin = F.floor(F.col("at") / bin_size)
    # In its own bin an event counts for the places from it to the bin's end, in all later bins for each of theirs.
    sums = events.groupBy("sample_id", "chrom", at_bin.alias("bin")).agg(F.sum(F.col("d") * ((at_bin + 1) * bin_size - F.col("at"))).alias("own"), F.sum("d").alias("go_on"))
    last = F.floor((F.col("length") - 1) / bin_size)
    grid = samples.select("sample_id").distinct().join(F.broadcast(lengths.where("length > 0").select("chrom", "length").distinct())).select("sample_id", "chrom", F.col("length").cast("long").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    bins_each = max(1, cell // bin_size)
    cells = grid.join(sums, ["sample_id", "chrom", "bin"], "left").withColumn("cell", F.floor(F.col("bin") / bins_each))
    within = Window.partitionBy("sample_id", "chrom", "cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.groupBy("sample_id", "chrom", F.floor(F.col("bin") / bins_each).alias("cell")).agg(F.sum("go_on").alias("n"))
    # What a cell hands on holds up to and with the next cell that has events, or the last of the chromosome.
    order = Window.partitionBy("sample_id", "chrom").orderBy("cell")
    summed = before.select("sample_id", "chrom", "cell", F.sum("n").over(order).alias("carry"), F.lead("cell").over(order).alias("next"))
    to = F.coalesce("next", F.floor(F.floor((F.col("length") - 1) / bin_size) / bins_each))
    carried = summed.join(known, "chrom").where("carry <> 0").select("sample_id", "chrom", "carry", F.explode(F.when(to > F.col("cell"), F.sequence(F.col("cell") + 1, to))).alias("cell"))
    depth = cells.join(carried, ["sample_id", "chrom", "cell"], "left")
    reach = F.coalesce(F.sum("go_on").over(within), F.lit(0)) + F.coalesce("carry", F.lit(0))
    start, end = F.col("bin") * bin_size, F.least((F.col("bin") + 1) * bin_size, F.col("length"))
    # Own sums count up to the full bin; a bin that the chromosome cuts off gets back what lies beyond its end.
    beyond = (F.col("bin") + 1) * bin_size - end
    inside = F.coalesce("own", F.lit(0)) - beyond * F.coalesce("go_on", F.lit(0))
    return depth.withColumn("reach", reach).select("sample_id", "chrom", start.alias("start"), end.alias("end"), ((F.col("reach") * (end - start) + inside) / (end - start)).alias("depth"))
