"""Population normalisation of binned depth, in long form: a missing cell is a missing row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.intervals import bins_in_region, unmasked

KEY = ["start", "end"]


def last_wins(rows: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """Of rows with equal keys the values of that with the largest `order`, summed up before the shuffle."""
    return rows.groupBy(*key).agg(*(F.max_by(v, order).alias(v) for v in values))


def population_mean_depth(bins: DataFrame) -> DataFrame:
    """(start, end, mean_depth) over the samples that have the bin."""
    return bins.groupBy(*KEY).agg(F.avg("depth").alias("mean_depth"))


def valid_regions(means: DataFrame, min_depth: float, max_depth: float) -> DataFrame:
    return means.where(F.col("mean_depth").between(min_depth, max_depth))


def valid_bins(bins: DataFrame, cells: DataFrame, chrom: str, start: int | None, end: int | None, min_depth: float, max_depth: float) -> DataFrame:
    """(sample_id, start, end, depth): positive depth, in the region, unmasked, population mean within bounds."""
    usable = unmasked(bins_in_region(bins, chrom, start, end), cells)
    kept = valid_regions(population_mean_depth(usable), min_depth, max_depth)
    return usable.join(kept.select(*KEY), KEY, "left_semi").select("sample_id", *KEY, "depth")


def sample_scale(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id").agg(F.avg("depth").alias("scale"))


def row_normalized(cells: DataFrame) -> DataFrame:
    """(sample_id, start, end, x): depth by the sample's mean; null where that is 0."""
    return cells.join(sample_scale(cells), "sample_id").select("sample_id", *KEY, F.try_divide("depth", "scale").alias("x"))


def region_stats(cells: DataFrame) -> DataFrame:
    """(start, end, mu, var, ratio): mean and variance of x over samples, and 100 var / mu where mu > 0.

    The variance divides by the number of all samples less one, also where cells are missing; a single sample has none.
    """
    x = row_normalized(cells)
    n = cells.agg(F.count_distinct("sample_id")).scalar()
    means = x.groupBy(*KEY).agg(F.avg("x").alias("mu"))
    squares = x.join(means, KEY).groupBy(*KEY).agg(F.first("mu").alias("mu"), F.sum(F.pow(F.col("x") - F.col("mu"), 2)).alias("ss"))
    var = F.try_divide(F.col("ss"), (n - 1).cast("double"))
    return squares.withColumn("var", var).select(*KEY, "mu", "var", F.when(F.col("mu") > 0, 100 * F.col("var") / F.col("mu")).alias("ratio"))


def median_rescale(stats: DataFrame) -> DataFrame:
    """One row (median_ratio, c): c = 1 / sqrt(median / 100), 1 if there is no positive median."""
    med = stats.agg(F.median("ratio").alias("median_ratio"))
    return med.withColumn("c", F.when(F.col("median_ratio") > 0, 1 / F.sqrt(F.col("median_ratio") / 100)).otherwise(F.lit(1.0)))


def z_matrix(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """(sample_id, start, end, z): (x - mu) / sqrt(mu) times c; where mu is not positive, x times c."""
    c = median_rescale(stats).select("c").scalar()
    joined = row_normalized(cells).join(stats.select(*KEY, "mu"), KEY)
    z = F.when(F.col("mu") > 0, (F.col("x") - F.col("mu")) / F.sqrt(F.abs("mu"))).otherwise(F.col("x"))
    return joined.select("sample_id", *KEY, (z * c).alias("z"))


def _kept(stats: DataFrame, column: str, keep: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """The rows for which keep(value of the column, sorted known values, number of rows) holds. There is one row for each
    region, which bounds the arrays.

    Rows and the bound that they are held against come from one evaluation: sums in another order differ in their last
    bits, so that a bound which is evaluated apart can lie above the very row that it stands for.
    """
    whole = stats.agg(F.collect_list(F.struct(*stats.columns)).alias("_rows"), F.array_sort(F.collect_list(column)).alias("_values"))
    return whole.select(F.inline(F.filter("_rows", lambda r: keep(r[column], F.col("_values"), F.size("_rows")))))


def selected_regions(stats: DataFrame, top_frac: float) -> DataFrame:
    """Regions whose ratio is above that at place floor(top_frac * n) of the sorted ratios: with 0.1 about nine tenths."""
    if not 0 <= top_frac < 1:
        raise ValueError("top_frac must be from 0 to below 1")
    return _kept(stats, "ratio", lambda x, known, _: x > F.get(known, F.floor(F.size(known) * F.lit(top_frac)).cast("int")))


def variance_filter(stats: DataFrame, sigma2_max: float = 1000.0, frac_r: float = 1.0) -> DataFrame:
    """Regions with known ratio from sigma2_min to sigma2_max; all regions if none is known.

    sigma2_min stands at place min(floor(R * (1 - frac_r)), known - 1) of the sorted known ratios; R counts all regions.
    """

    def keep(x: Column, known: Column, r: Column) -> Column:
        place = F.greatest(F.least(F.floor(r * F.lit(1.0 - frac_r)), F.size(known) - 1), F.lit(0)).cast("int")
        return (F.size(known) == 0) | ((x >= F.get(known, place)) & (x <= sigma2_max))

    return _kept(stats, "ratio", keep)


def extreme_columns(stats: DataFrame, sigma2_max: float) -> DataFrame:
    """One row (extreme long): regions whose ratio is above the bound; an unknown ratio is not."""
    return stats.agg(F.count_if((F.col("ratio") > sigma2_max) & ~F.isnan("ratio")).alias("extreme"))


def z_selected(z: DataFrame, selected: DataFrame) -> DataFrame:
    return z.join(selected.select(*KEY), KEY, "left_semi")


def matrix_pivot(cells: DataFrame, starts: list[int], value: str = "depth") -> DataFrame:
    """One row for each sample, one column b<start> for each of a few bins; the last value (the largest) of a repeated
    cell holds. For export; everything else works on the long form."""
    return cells.where(F.col("start").isin(starts)).groupBy("sample_id").agg(*(F.max(F.when(F.col("start") == s, F.col(value))).alias(f"b{s}") for s in starts))
