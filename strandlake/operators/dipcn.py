"""Diploid copy number from reads and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions.columns import exon_count


def diploid_cn(neighbors: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(sample_id, dip_cn): reads by scale, over the same mean of the first k neighbours that have reads.

    The cap counts neighbours with reads only. Samples without reads, without such a neighbour, or with a zero scale or
    mean have no row.
    """
    own = reads.select("sample_id", F.col("reads").alias("own_reads"))
    other = reads.select(F.col("sample_id").alias("nbr_id"), F.col("reads").alias("nbr_reads"))
    met = neighbors.join(own, "sample_id").join(other, "nbr_id")
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("rank"))
    first = met.withColumn("nth", nth).where(F.col("nth") <= k)
    mean = first.groupBy("sample_id").agg(F.first("own_reads").alias("r"), F.first("scale").alias("s"), F.avg(F.try_divide("nbr_reads", "nbr_scale")).alias("m"))
    return mean.select("sample_id", F.try_divide(F.try_divide("r", "s"), "m").alias("dip_cn")).where("dip_cn is not null")


def missing_neighbors(neighbors: DataFrame, reads: DataFrame) -> DataFrame:
    """(nbr_id, lists): neighbours without reads and in how many lists they stand."""
    asked = neighbors.groupBy("nbr_id").agg(F.count(F.lit(1)).alias("lists"))
    return asked.join(reads.select(F.col("sample_id").alias("nbr_id")), "nbr_id", "left_anti")


def exon_cn(counts: DataFrame, neighbors: DataFrame, kind: str, k: int = 200) -> DataFrame:
    """(sample_id, dip_cn) from exon counts: the first k neighbours are taken first, and of them those with counts and
    scale above 0. Samples whose own count, scale or mean is not positive have no row."""
    own = counts.select("sample_id", exon_count(kind).alias("own"))
    other = own.select(F.col("sample_id").alias("nbr_id"), F.col("own").alias("nbr"))
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("rank"))
    first = neighbors.withColumn("nth", nth).where(F.col("nth") <= k)
    met = first.join(own.where("own > 0"), "sample_id").join(other.where("nbr > 0"), "nbr_id").where("scale > 0 and nbr_scale > 0")
    mean = met.groupBy("sample_id").agg((F.first("own") / F.first("scale")).alias("x"), F.avg(F.col("nbr") / F.col("nbr_scale")).alias("m"))
    return mean.where("m > 0").select("sample_id", (F.col("x") / F.col("m")).alias("dip_cn"))


def sample_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct sample ids that both have; an error is the caller's to raise if there is none."""
    return a.select("sample_id").intersect(b.select("sample_id"))


def cn_estimate(exon1a: DataFrame, exon1b: DataFrame) -> DataFrame:
    """(sample_id, dip_estimate, hap_estimate) of the samples in both(sample_id, cn)."""
    from strandlake.functions.columns import estimate

    met = exon1a.select("sample_id", F.col("cn").alias("a")).join(exon1b.select("sample_id", F.col("cn").alias("b")), "sample_id")
    dip = estimate(F.col("a"), F.col("b"))
    return met.select("sample_id", dip.alias("dip_estimate"), (dip / 2).alias("hap_estimate"))


def cn_summary(estimates: DataFrame) -> DataFrame:
    """One row for dip and hap: mean, median, sample standard deviation, least, most."""
    long = estimates.select(F.explode(F.array(F.struct(F.lit("dip").alias("kind"), F.col("dip_estimate").alias("v")), F.struct(F.lit("hap").alias("kind"), F.col("hap_estimate").alias("v")))).alias("e")).select("e.*")
    return long.groupBy("kind").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
