"""Readers of the text formats, as DataFrames. Compressed files are decoded by their suffix; malformed lines are skipped
by lenient casts. Where the order of lines counts, `line_no` sorts as they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.columns import cigar_length, norm_chrom, normalize_sample_id
from strandlake.operators.files import longest_prefix_sample
from strandlake.operators.numbering import numbered
from strandlake.sources.bgzf import paths, read_lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): line_no sorts as the lines stand, by file, by the block of the file that a task reads, and within
    it. It is no number, since counting would need one task for a file."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(order.alias("line_no"), "value")


def _without_first(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line_no") > lines.agg(F.min("line_no")).scalar())


def _at(fields: Column, i: int) -> Column:
    """A field, null where a line has fewer: conditions on fields may be evaluated before that on their number."""
    return F.get(fields, F.lit(i))


def _cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def _number(c: Column) -> Column:
    """A double; NA, NaN and anything else that is no number are null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, ord): trimmed, blank lines dropped, in file order."""
    rows = _lines(spark, path).select("line_no", F.trim("value").alias("sample_id")).where("sample_id <> ''")
    return numbered(rows, ["line_no"], "ord").select("sample_id", "ord")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path) of a folder's files by name pattern, not recursive; contents are not read, empty files are left out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments as Parquet; conditions on chrom and pos reach the scan."""
    return spark.read.parquet(path)


def read_sam(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    """Alignments of a SAM text file: headers skipped, positions from 0, `=` as the own reference; `end` is the place after
    the last that the CIGAR covers, of one that covers none the next place."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith(F.col("value"), F.lit("@"))).where(F.size(f) >= 7)
    return rows.select(
        F.lit(sample_id).alias("sample_id"), _at(f, 2).alias("chrom"), (_cast(_at(f, 3), "bigint") - 1).alias("pos"), _cast(_at(f, 1), "int").alias("flag"),
        _cast(_at(f, 4), "int").alias("mapq"), F.when(_at(f, 6) == "=", _at(f, 2)).otherwise(_at(f, 6)).alias("next_chrom"),
        (_cast(_at(f, 3), "bigint") - 1 + F.greatest(F.lit(1).cast("long"), cigar_length(_at(f, 5)))).alias("end"),
    ).dropna(subset=["pos", "flag", "mapq"])


def read_depth(spark: SparkSession, path: str, samples: DataFrame | None = None, suffix: str = ".bed.gz", split_bytes: int | None = None) -> DataFrame:
    """(sample_id, chrom, start, end, depth) of BED files with four columns or more. The sample is the longest known
    prefix of the file's name, or without samples the name up to its first dot.

    split_bytes: files of the folder with that suffix are read in splits of so many bytes where they are blocked gzip, so
    that a large file keeps several tasks busy; None leaves them to Spark's reader, one task for a compressed file.
    """
    f = F.split("value", "\t")
    lines = read_lines(spark, path, suffix, split_bytes) if split_bytes else spark.read.text(path).withColumn("path", F.input_file_name())
    rows = lines.where(F.size(f) >= 4)
    cells = rows.select("path", _at(f, 0).alias("chrom"), _cast(_at(f, 1), "bigint").alias("start"), _cast(_at(f, 2), "bigint").alias("end"), _number(_at(f, 3)).alias("depth")).dropna(subset=["start", "end", "depth"])
    if samples is None:
        name = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
        return cells.select(name.alias("sample_id"), "chrom", "start", "end", "depth")
    files = paths(spark, path, suffix) if split_bytes else cells.select("path").distinct()
    owners = longest_prefix_sample(files, samples)
    return cells.join(owners, "path").select("sample_id", "chrom", "start", "end", "depth")


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end): comments, blank and short lines and those without numbers are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#"))).where(F.size(f) >= 3)
    return rows.select(_at(f, 0).alias("chrom"), _cast(_at(f, 1), "bigint").alias("start"), _cast(_at(f, 2), "bigint").alias("end")).dropna()


def read_normalized(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratios(at, ratio), scales(sample_id, scale), cells(sample_id, at, z)) of a normalised matrix: the first line is
    skipped, the second has ratios from its third field on, then one line for each sample."""
    lines = _lines(spark, path).withColumn("f", F.split("value", "\t"))
    later = _without_first(lines)
    second = later.agg(F.min("line_no")).scalar()
    ratios = later.where(F.col("line_no") == second).select(F.posexplode(F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0)))).alias("at", "v")).select("at", _number(F.col("v")).alias("ratio"))
    rows = later.where((F.col("line_no") > second) & (F.col("value") != ""))
    scales = rows.select(_at(F.col("f"), 0).alias("sample_id"), _number(F.get("f", F.lit(1))).alias("scale"))
    cells = rows.select(_at(F.col("f"), 0).alias("sample_id"), F.posexplode(F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0)))).alias("at", "v")).select("sample_id", "at", _number(F.col("v")).alias("z"))
    return ratios, scales, cells.where("z is not null")


def read_neighbors(spark: SparkSession, path: str, whole_triplets: bool = False, clean_ids: bool = False) -> DataFrame:
    """(sample_id, scale, rank, nbr_id, nbr_scale, norm_dist) of ragged lines. A triplet without a scale is skipped; a
    last pair without a distance counts unless whole_triplets. clean_ids: names lose their file suffixes."""
    clean = normalize_sample_id if clean_ids else (lambda c: c)
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 2).select(clean(_at(f, 0)).alias("sample_id"), _number(_at(f, 1)).alias("scale"), F.slice(f, F.lit(3), F.size(f)).alias("r")).where("scale is not null")
    last = F.floor(F.size("r") / 3) if whole_triplets else F.floor((F.size("r") + 1) / 3)
    each = rows.where(last > 0).select("sample_id", "scale", "r", F.explode(F.sequence(F.lit(0), last.cast("int") - 1)).alias("i"))
    at = lambda k: F.get("r", F.col("i") * 3 + k)
    found = each.select("sample_id", "scale", (F.col("i") + 1).alias("rank"), clean(at(0)).alias("nbr_id"), _number(at(1)).alias("nbr_scale"), _number(at(2)).alias("norm_dist"))
    return found.where("nbr_scale is not null")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, reads): header skipped, `Error` and other words dropped, of repeated samples the last line."""
    f = F.split("value", "\t")
    rows = _without_first(_lines(spark, path)).select("line_no", _at(f, 0).alias("sample_id"), _number(F.get(f, F.lit(1))).alias("reads")).where("reads is not null")
    return rows.groupBy("sample_id").agg(F.max_by("reads", "line_no").alias("reads"))


def read_exon_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, kiv3, kiv2, tied, exon1a): exactly five fields with whole numbers, other lines skipped, last wins."""
    f = F.split(F.trim("value"), "\t")
    names = ["kiv3", "kiv2", "tied", "exon1a"]
    rows = _lines(spark, path).where(F.size(f) == 5).select("line_no", normalize_sample_id(_at(f, 0)).alias("sample_id"), *(_cast(_at(f, i), "bigint").alias(n) for i, n in enumerate(names, 1)))
    return rows.dropna().groupBy("sample_id").agg(*(F.max_by(n, "line_no").alias(n) for n in names))


def read_dipcn(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, idx, irr): two fields by white space; lines without a number, such as a header, drop out; idx counts
    the rows that stay."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.size(f) >= 2).select("line_no", _at(f, 0).alias("sample_id"), _number(_at(f, 1)).alias("irr")).where("irr is not null")
    return numbered(rows, ["line_no"], "idx").select("sample_id", "idx", "irr")


def read_ibs(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id, hap, nbr_id, nbr_hap): header skipped, seven fields or more by white space, haplotypes 1 and 2."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _without_first(_lines(spark, path)).where(F.size(f) >= 7)
    return rows.select("line_no", _at(f, 0).alias("id"), _cast(_at(f, 1), "int").alias("hap"), _at(f, 5).alias("nbr_id"), _cast(_at(f, 6), "int").alias("nbr_hap")).where("hap in (1, 2) and nbr_hap in (1, 2)")


def read_ibd(spark: SparkSession, path: str) -> DataFrame:
    """Segments of eleven fields by tabulators, or else by white space."""
    tabs, spaces = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).withColumn("f", F.when(F.size(tabs) >= 11, tabs).otherwise(spaces)).where(F.size("f") >= 11)
    at = lambda i: _at(F.col("f"), i)
    return rows.select(
        "line_no", at(0).alias("id1"), at(1).alias("hap1"), at(2).alias("id2"), at(3).alias("hap2"), _cast(at(5), "bigint").alias("bp1"),
        _cast(at(6), "bigint").alias("bp2"), _number(at(9)).alias("length"), _number(at(10)).alias("match"),
    ).dropna(subset=["bp1", "bp2", "length", "match"])


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(position, cm): first and last numbers of lines by white space; comments and headers drop out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.startswith(F.col("value"), F.lit("#")))
    return rows.select(_cast(_at(f, 0), "bigint").alias("position"), _number(F.element_at(f, -1)).alias("cm")).dropna()


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(chr, snp, cm, bp) of a four-column map."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 4).select(_at(f, 0).alias("chr"), _at(f, 1).alias("snp"), _number(_at(f, 2)).alias("cm"), _cast(_at(f, 3), "bigint").alias("bp")).where("bp is not null")


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, chrom, start, end, name): fields 1 to 3 and 7."""
    f = F.split("value", r"\s+")
    return _lines(spark, path).where(F.size(f) >= 7).select("line_no", _at(f, 0).alias("chrom"), _cast(_at(f, 1), "bigint").alias("start"), _cast(_at(f, 2), "bigint").alias("end"), _at(f, 6).alias("name"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, population): the first two fields, without the header."""
    f = F.split(F.trim("value"), r"\s+")
    return _without_first(_lines(spark, path)).where(F.size(f) >= 2).select(_at(f, 0).alias("sample_id"), _at(f, 1).alias("population"))


def map_of_chromosome(rows: DataFrame, chrom: str) -> DataFrame:
    """The rows of one chromosome of a map, whether names have `chr` before them or not."""
    return rows.where(norm_chrom(F.col("chr")) == norm_chrom(F.lit(chrom)))
