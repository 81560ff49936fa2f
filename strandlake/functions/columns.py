"""Column expressions of the read-depth model. All stay inside code generation; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the SAM flag.
FLAG_SECONDARY, FLAG_DUPLICATE = 256, 1024
#: Fixed value: the suffix that file names of the public cohort carry.
SUBSET_SUFFIX = ".b38.irc.v1_subset"
#: The linear copy-number estimator, dip = A * exon1A + B * exon1B - C.
ESTIMATE_1A, ESTIMATE_1B, ESTIMATE_OFFSET = 34.9, 5.2, 1.0
#: Fixed value: what is added to the sum of weights of a neighbour mean.
PRIOR_WEIGHT = 1e-9


def norm_chrom(chrom: Column) -> Column:
    """The name with `chr` before it, unless it begins so."""
    return F.when(F.startswith(chrom, F.lit("chr")), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def normalize_sample_id(name: Column) -> Column:
    """Trimmed, without the subset suffix and one trailing .cram or else .bam."""
    bare = F.replace(F.trim(name), F.lit(SUBSET_SUFFIX), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"\.(cram|bam)$", ""))


def region_string(chrom: str | None, start: int | None, end: int | None) -> str:
    """`chrom:start-end`; an error if a part is missing."""
    if not chrom or start is None or end is None:
        raise ValueError("a region needs chrom, start_bp and end_bp")
    return f"{chrom}:{start}-{end}"


def kb(position: Column) -> Column:
    return F.floor(position / 1000).cast("long")


def overlap(start: Column, end: Column, low: Column | int, high: Column | int) -> Column:
    """Length that two half-open intervals share; below 1 if none."""
    low, high = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (low, high))
    return F.least(end, high) - F.greatest(start, low)


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def reads_pass(flags: list[int], min_mapq: int, chrom: str, start: int, end: int) -> Column:
    """The seven conditions on an alignment; flags are compared whole, not by bit."""
    return (
        F.col("flag").isin(flags or [-1])
        & (F.col("mapq") >= min_mapq)
        & (F.col("chrom") == F.col("next_chrom"))
        & (F.col("flag").bitwiseAND(FLAG_DUPLICATE) == 0)
        & (F.col("flag").bitwiseAND(FLAG_SECONDARY) == 0)
        & (F.col("chrom") == chrom)
        & (F.col("pos") >= start)
        & (F.col("pos") < end)
    )


def clip(z: Column, zmax: float) -> Column:
    """z within ±zmax, missing (null or NaN) as 0."""
    known = F.coalesce(F.nanvl(z, F.lit(None).cast("double")), F.lit(0.0))
    return F.greatest(F.lit(-zmax), F.least(known, F.lit(zmax)))


def segment_distance(bp1: Column, bp2: Column, start: int, end: int) -> Column:
    """How far a segment lies from the region; 0 if they touch."""
    return F.when(bp2 < start, start - bp2).when(bp1 > end, bp1 - end).otherwise(F.lit(0).cast("long"))


def lorentzian(distance: Column, match: Column, scale: float) -> Column:
    return F.lit(float(scale)) / (distance + F.lit(float(scale))) * match


def hap_node(index: Column, hap: Column) -> Column:
    """Node of haplotype 0 or 1 of a sample."""
    return index * 2 + hap


def exon_count(kind: str) -> Column:
    """Reads of an exon kind from kiv3, kiv2, tied, exon1a; missing ones count 0; an unknown kind is an error."""
    k = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("kiv3", "kiv2", "tied", "exon1a")}
    kinds = {"1B_KIV3": k["kiv3"], "1B_notKIV3": k["kiv2"] + k["tied"], "1B": k["kiv3"] + k["kiv2"] + k["tied"], "1A": k["exon1a"]}
    if kind not in kinds:
        raise ValueError(f"unknown exon type {kind}; known: {', '.join(kinds)}")
    return kinds[kind]


def estimate(exon1a: Column, exon1b: Column) -> Column:
    return F.lit(ESTIMATE_1A) * exon1a + F.lit(ESTIMATE_1B) * exon1b - F.lit(ESTIMATE_OFFSET)


def cigar_length(cigar: Column) -> Column:
    """Places of the reference that an alignment covers: the lengths of M, D, N, = and X."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda n, x: n + x.try_cast("bigint"))


def covered_blocks(pos: Column, cigar: Column) -> Column:
    """The half-open ranges of the reference under the operations M, = and X of an alignment that begins at pos."""
    parts = F.transform(
        F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), 0),
        lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).try_cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")),
    )
    begin = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(s: Column, x: Column) -> Column:
        n = F.coalesce(x["n"], F.lit(0).cast("long"))
        after = F.when(x["op"].isin("M", "D", "N", "=", "X"), s["at"] + n).otherwise(s["at"])
        own = F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"))
        return F.struct(after.alias("at"), F.when(x["op"].isin("M", "=", "X") & (n > 0), F.array_append(s["blocks"], own)).otherwise(s["blocks"]).alias("blocks"))

    return F.aggregate(parts, begin, step, lambda s: s["blocks"])
