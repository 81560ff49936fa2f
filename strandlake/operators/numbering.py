"""Gapless numbers in a given order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.tables import materialize


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with a column `name` long: their place in the order of `by`, from 0; ties in any order.

    Ranges of the order are sorted apart and written; each row's place in its range is known from the way in which Spark
    numbers the rows of a partition. How many rows the ranges before have, one number a range, gives the rest.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # The number of a partition is in the bits from the 33rd on.
    place = F.monotonically_increasing_id()
    own = materialize(dealt.withColumns({"_range": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    begin, starts = 0, []
    for r in own.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], begin))
        begin += r["n"]
    placed = own.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long")), "_range")
    return placed.select(*rows.columns, (F.col("_start") + F.col("_place")).alias(name))
