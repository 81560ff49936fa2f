"""The driver's star-schema tables seen as cohort inputs: suppliers are samples. Deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROM, START, END = "chr6", 5000, 78000
MIN_DEPTH, MAX_DEPTH, TOP_FRAC, ZMAX, K = 44, 100, 0.1, 2.0, 20
READ_CHROM, READ_START, READ_END = "chr6", 20000, 60000
FLAGS = [83, 147, 81, 145, 99]
FLAG_OF_LINE = [83, 147, 81, 145, 1107, 339, 99]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(key: str) -> F.Column:
    return F.format_string("S%05d", F.col(key))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_name("s_suppkey").alias("sample_id"), F.col("s_suppkey").alias("idx"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chrom = F.concat(F.lit("chr"), (F.col("l_orderkey") % 3 + 5).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        _name("l_suppkey").alias("sample_id"), chrom.alias("chrom"), ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 100000).alias("pos"),
        F.element_at(F.array(*(F.lit(f) for f in FLAG_OF_LINE)), F.col("l_linenumber")).alias("flag"), (F.col("l_quantity").cast("int") - 1).alias("mapq"),
        F.when(F.col("l_discount") >= 0.095, "chrX").otherwise(chrom).alias("next_chrom"),
        ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 100000 + 100 + 20 * F.col("l_linenumber")).alias("end"),
    )


def depth_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey"), month.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    depth = F.when(F.col("n") == 1, 0.0).otherwise(F.col("q") / 4)
    return grouped.select(_name("l_suppkey").alias("sample_id"), F.lit("chr6").alias("chrom"), (F.col("m") * 1000).alias("start"), (F.col("m") * 1000 + 1000).alias("end"), depth.alias("depth"))


def repeat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("n_nationkey").cast("long") * 10300
    return table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.when(F.col("n_regionkey") % 2 == 0, "chr6").otherwise("6").alias("chrom"), start.alias("start"), (start + 200).alias("end"))


def exon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda flag, status: F.count_if((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status))
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        many("A", "F").alias("kiv3"), many("N", "O").alias("kiv2"), many("R", "F").alias("tied"), many("N", "F").alias("exon1a"))
    return counted.select(_name("l_suppkey").alias("sample_id"), "kiv3", "kiv2", "tied", "exon1a")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line_no = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line_no", line_no)


def ibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    hap = F.col("l_linenumber") % 2 + 1
    rows = _lines(spark, sf_dir).where(~((F.col("l_suppkey") % 10 == 0) & (hap == 2)))
    return rows.select("line_no", _name("l_suppkey").alias("id"), hap.alias("hap"), F.format_string("S%05d", F.col("l_partkey") % n).alias("nbr_id"), (F.col("l_orderkey") % 2 + 1).alias("nbr_hap"))


def ibd(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    bp1 = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long") * 1000
    name, other = _name("l_suppkey"), F.format_string("S%05d", F.col("l_partkey") % n)
    return _lines(spark, sf_dir).select(
        "line_no", name.alias("id1"), F.concat(name, F.lit("_"), (F.col("l_linenumber") % 2).cast("string")).alias("hap1"),
        other.alias("id2"), F.concat(other, F.lit("_"), (F.col("l_orderkey") % 2).cast("string")).alias("hap2"),
        bp1.alias("bp1"), (bp1 + F.col("l_quantity").cast("long") * 1000).alias("bp2"), (F.col("l_quantity") / 10).alias("length"), (1 - 2.5 * F.col("l_discount")).alias("match"),
    )


def irr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("idx")).agg((F.sum("l_extendedprice") / 1e7).alias("irr"))


def genetic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth part is a knot; its cM is the sum of the prices of the knots up to it. Prices are a function of the
    key in a small range, so the running sum is over a few hundred rows."""
    from pyspark.sql.window import Window

    part = table(spark, sf_dir, "part").where("p_partkey % 10 = 0")
    cm = F.sum("p_retailprice").over(Window.orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)) / 1e5
    return part.select((F.col("p_partkey") * 1000).alias("position"), cm.alias("cm"))


def map_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 997 - 3000).alias("bp")).distinct()
