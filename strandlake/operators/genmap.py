"""Linear interpolation of a genetic map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width in base pairs of the cells on which queries meet map intervals.
CELL = 1_000_000


def interpolate(queries: DataFrame, knots: DataFrame, cell: int = CELL) -> DataFrame:
    """(bp, cm) of queries(bp) on knots(position, cm): linear between knots, the end values beyond.

    Intervals between neighbouring knots are spread over cells and met by equality, so queries never sort in one task;
    of knots at one position the last value (the largest) holds. The map is small (a chromosome has thousands of knots)
    and is ordered in one task. Without knots cm is null; a null bp stays null.
    """
    known = knots.groupBy("position").agg(F.max("cm").alias("cm"))
    along = Window.orderBy("position")
    spans = known.select(F.col("position").alias("p0"), F.col("cm").alias("c0"), F.lead("position").over(along).alias("p1"), F.lead("cm").over(along).alias("c1"))
    ends = known.agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.min_by("cm", "position").alias("clo"), F.max_by("cm", "position").alias("chi"))
    e = {c: ends.select(c).scalar() for c in ends.columns}
    at = lambda c: F.floor(c / cell)
    spread = spans.where("p1 is not null").withColumn("cell", F.explode(F.sequence(at(F.col("p0")), at(F.col("p1")))))
    asked = queries.select("bp").withColumn("cell", at(F.col("bp")))
    met = asked.join(spread, (asked["cell"] == spread["cell"]) & (F.col("bp") >= F.col("p0")) & (F.col("bp") < F.col("p1")), "left")
    inner = F.col("c0") + (F.col("bp") - F.col("p0")) * (F.col("c1") - F.col("c0")) / (F.col("p1") - F.col("p0"))
    return met.select("bp", F.when(F.col("bp") <= e["lo"], e["clo"]).when(F.col("bp") >= e["hi"], e["chi"]).otherwise(inner).alias("cm"))
