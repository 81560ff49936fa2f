"""Samples and their files, loci, lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Index suffixes by type of alignment file.
INDEX_SUFFIXES = {"cram": (".cram.crai", ".crai"), "bam": (".bam.bai", ".bai")}


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def sample_prefixes(name: Column) -> Column:
    """The name and all prefixes of it that end before a `_`, longest first."""
    parts = F.split(name, "_")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))


def longest_prefix_sample(files: DataFrame, samples: DataFrame) -> DataFrame:
    """(path, sample_id): the longest `_`-joined prefix of each file's stem that is a known sample; others have no row."""
    tried = files.select("path", F.posexplode(sample_prefixes(stem(F.col("path")))).alias("nth", "sample_id"))
    return tried.join(samples.select("sample_id").distinct(), "sample_id").groupBy("path").agg(F.min_by("sample_id", "nth").alias("sample_id"))


def names_inside(files: DataFrame, samples: DataFrame) -> DataFrame:
    """(path, sample_id): all known names that occur anywhere in a file's name up to its last dot.

    All patterns are looked for at once: a name's parts of each length that a sample's name has meet the samples by
    equality, so neither side is broadcast and no file is compared with each sample. Lengths are few, file names short.
    """
    known = samples.select("sample_id").where("sample_id <> ''").distinct()
    sizes = known.agg(F.array_sort(F.collect_set(F.length("sample_id")))).scalar()
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    sized = files.select("path", name.alias("name")).distinct().select("path", "name", F.explode(sizes).alias("n")).where(F.col("n") <= F.length("name"))
    parts = sized.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda i: F.substring(F.col("name"), i, F.col("n")))).alias("sample_id"))
    return parts.distinct().join(known, "sample_id").select("path", "sample_id")


def find_file_contains(files: DataFrame, samples: DataFrame, file_type: str | None) -> DataFrame:
    """(sample_id, path): the first path of the type whose file name has the sample's name anywhere before the suffix, null
    without one, or without a type. Names may overlap: S1 is in the file of S10 too."""
    typed = files.where(F.endswith(F.col("path"), F.lit(f".{file_type}"))) if file_type else files.where("false")
    found = names_inside(typed, samples).groupBy("sample_id").agg(F.min("path").alias("path"))
    return samples.select("sample_id").distinct().join(found, "sample_id", "left")


def find_file(files: DataFrame, samples: DataFrame, file_type: str | None) -> DataFrame:
    """(sample_id, path): the first path of the type that belongs to the sample, null without one.

    A file whose name begins with a sample's name belongs to the longest such name. A sample without such a file has the
    first that holds its name and begins with no sample's name, such as run7_S1_x.cram for S1.
    """
    typed = files.where(F.endswith(F.col("path"), F.lit(f".{file_type}"))) if file_type else files.where("false")
    begun = longest_prefix_sample(typed, samples)
    owned = begun.groupBy("sample_id").agg(F.min("path").alias("path"))
    others = names_inside(typed.join(begun.select("path"), "path", "left_anti"), samples).groupBy("sample_id").agg(F.min("path").alias("inside"))
    return samples.select("sample_id").distinct().join(owned, "sample_id", "left").join(others, "sample_id", "left").select("sample_id", F.coalesce("path", "inside").alias("path"))


def file_status(samples: DataFrame, files: DataFrame, file_type: str) -> DataFrame:
    """(sample_id, status): has_index, missing_index or missing_file."""
    found = find_file(files, samples, file_type)
    whole, bare = INDEX_SUFFIXES.get(file_type.lower(), (None, None))
    path = F.col("path")
    names = F.array(F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(whole)), F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(bare)))
    asked = found.select("sample_id", "path", F.explode_outer(names if whole else F.array().cast("array<string>")).alias("index"))
    seen = asked.join(files.select(F.col("path").alias("index")).distinct().withColumn("there", F.lit(1)), "index", "left")
    return seen.groupBy("sample_id").agg(
        F.when(F.max("path").isNull(), "missing_file").when(F.max("there").isNull(), "missing_index").otherwise("has_index").alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("samples"))


def accounting(samples: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row (total, ok, failed, unaccounted) of distinct sample ids."""
    count = lambda df: df.agg(F.count_distinct("sample_id").alias("n")).scalar()
    known = samples.agg(F.count_distinct("sample_id").alias("total"))
    both = known.withColumns({"ok": count(done), "failed": count(failed)})
    return both.withColumn("unaccounted", F.col("total") - F.col("ok") - F.col("failed"))


def locus_lookup(loci: DataFrame, name: str) -> DataFrame:
    """(chrom, start, end, midpoint) of the first line with the name."""
    first = loci.where(F.col("name") == name).orderBy("line_no").limit(1)
    return first.select("chrom", "start", "end", F.expr("(start + end) div 2").alias("midpoint"))


def parse_counts(lines: DataFrame) -> DataFrame:
    """(sample_id, reads double) of lines(line_no, sample_id, value): numbers only, of repeated samples the last."""
    known = lines.withColumn("reads", F.expr("try_cast(value as double)")).where("reads is not null and not isnan(reads)")
    return known.groupBy("sample_id").agg(F.max_by("reads", "line_no").alias("reads"))


def neighbor_lists(neighbors: DataFrame) -> DataFrame:
    """(line string): id, scale, then neighbour, scale and distance by tabulators, to two places; the text form of
    neighbours(sample_id, scale, rank, nbr_id, nbr_scale, norm_dist)."""
    two = lambda c: F.format_string("%.2f", c)
    triple = F.struct("rank", F.concat_ws("\t", "nbr_id", two(F.col("nbr_scale")), two(F.col("norm_dist"))).alias("t"))
    lists = neighbors.groupBy("sample_id", "scale").agg(F.array_sort(F.collect_list(triple)).alias("l"))
    return lists.select("sample_id", F.concat_ws("\t", "sample_id", two(F.col("scale")), F.transform("l", lambda x: x["t"])).alias("line"))


def first_by(rows: DataFrame, key: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; pruned before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
