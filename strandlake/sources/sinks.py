"""Writers of the text formats. Parquet is the way between steps; these are for exchange."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.columns import region_string
from strandlake.sources.bgzf import write_lines


def fixed(places: int, missing: str = "NA"):
    """A pandas UDF to exact decimal places of the binary value (Spark's rounding differs at decimal ties)."""

    @F.pandas_udf("string")
    def show(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v.map(lambda x: missing if pd.isna(x) else f"{x:.{places}f}")

    return show


def _delimiter(kind: str) -> str:
    return "," if kind == "csv" else "\t"


def write_table(df: DataFrame, path: str, kind: str = "tsv", header: bool = True) -> None:
    """Any table by tabulators, or commas for csv; nulls as NA. Parts are committed together, so no row is half there."""
    df.write.mode("overwrite").option("sep", _delimiter(kind)).option("header", header).option("nullValue", "NA").csv(path)


def write_counts(counts: DataFrame, path: str, chrom: str, start: int, end: int, kind: str = "tsv") -> None:
    """Sample and the region's reads; a null count is written as Error."""
    shown = F.coalesce(F.col("reads").cast("string"), F.lit("Error"))
    write_table(counts.select(F.col("sample_id").alias("Sample"), shown.alias(region_string(chrom, start, end))), path, kind)


def _field(name: str):
    return lambda x: x[name]


def _row(first: list[Column], values: Column) -> Column:
    return F.concat_ws("\t", *first, F.concat_ws("\t", values))


def write_normalized(stats: DataFrame, scales: DataFrame, z: DataFrame, path: str) -> None:
    """The normalised matrix: a line of means and one of ratios, each after the numbers of samples and regions, then one
    line for each sample, by name, with scale and z in the order of the regions; NA for missing. One file, whose lines
    several tasks write."""
    three, two = fixed(3), fixed(2)
    order = F.struct("start", "end")
    n, r = scales.agg(F.count(F.lit(1))).scalar().cast("string"), stats.agg(F.count(F.lit(1))).scalar().cast("string")
    shown = stats.select(order.alias("k"), three("mu").alias("mu"), three("ratio").alias("ratio"))
    sides = [shown.agg(F.array_sort(F.collect_list(F.struct("k", c))).alias("l")).select(F.lit(i).alias("o"), F.lit("").alias("s"), _row([n, r], F.transform("l", _field(c))).alias("value")) for i, c in enumerate(("mu", "ratio"))]
    regions = stats.agg(F.array_sort(F.collect_list(order))).scalar()
    cells = z.select("sample_id", F.struct(order.alias("k"), two("z").alias("v")).alias("c")).groupBy("sample_id").agg(F.map_from_entries(F.collect_list("c")).alias("m"))
    lines = scales.join(cells, "sample_id", "left").withColumn("ks", regions).select(
        F.lit(2).alias("o"), F.col("sample_id").alias("s"),
        _row([F.col("sample_id"), two("scale")], F.transform("ks", lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit("NA")))).alias("value"))
    write_lines(sides[0].unionByName(sides[1]).unionByName(lines).withColumn("name", F.lit("part-00000.tsv.gz")), path, ["o", "s"])


def write_neighbors(neighbors: DataFrame, path: str) -> None:
    """One line for each sample: id, scale, then neighbour, its scale and normalised distance, two places each."""
    two = fixed(2)
    shown = neighbors.select("sample_id", two("scale").alias("scale"), "rank", F.concat_ws("\t", "nbr_id", two("nbr_scale"), two("norm_dist")).alias("t"))
    lists = shown.groupBy("sample_id", "scale").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("l"))
    lists.select(_row([F.col("sample_id"), F.col("scale")], F.transform("l", lambda x: x["t"])).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def write_dipcn(dip: DataFrame, path: str, kind: str = "tsv") -> None:
    """Sample and Norm_Reads in full precision."""
    write_table(dip.select(F.col("sample_id").alias("Sample"), F.col("dip_cn").alias("Norm_Reads")), path, kind)


def write_exon_dipcn(dip: DataFrame, path: str) -> None:
    """ID and dipCN to six places, one file sorted by ID; a null is NA."""
    lines = dip.select(F.lit(1).alias("o"), F.col("sample_id").alias("s"), F.concat_ws("\t", "sample_id", fixed(6)("dip_cn")).alias("value"))
    head = dip.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("").alias("s"), F.lit("ID\tdipCN").alias("value"))
    write_lines(head.unionByName(lines).withColumn("name", F.lit("part-00000.tsv")), path, ["o", "s"])


def write_haplotypes(out: DataFrame, path: str) -> None:
    """Six columns to two places; not phased is nan."""
    two = fixed(2, "nan")
    names = {"irrs": "IRRs", "hap1phased": "hap1phased", "hap2phased": "hap2phased", "hap1imp": "hap1imp", "hap2imp": "hap2imp"}
    write_table(out.select(F.col("sample_id").alias("ID"), *(two(c).alias(n) for c, n in names.items())), path)


def write_map(rows: DataFrame, path: str) -> None:
    """chr, snp, cm, bp without a header."""
    write_table(rows.select("chr", "snp", "cm", "bp"), path, header=False)
