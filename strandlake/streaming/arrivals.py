"""Depth files as they arrive: Structured Streaming over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.columns import overlap


def depth_stream(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """(sample_id, chrom, start, end, depth) of new BED files; the sample is the name up to its first dot."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_each).text(folder).withColumn("path", F.input_file_name())
    f = F.split("value", "\t")
    name = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    return rows.where(F.size(f) >= 4).select(
        name.alias("sample_id"), f[0].alias("chrom"), f[1].try_cast("bigint").alias("start"), f[2].try_cast("bigint").alias("end"), f[3].try_cast("double").alias("depth")
    ).dropna()


def coverage_sums(stream: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(sample_id, weighted, covered): running sums from which the region's mean depth follows; two numbers a sample."""
    shared = overlap(F.col("start"), F.col("end"), start, end)
    hit = stream.where(F.col("chrom") == chrom).withColumn("ov", shared).where("ov > 0")
    return hit.groupBy("sample_id").agg(F.sum(F.col("depth") * F.col("ov")).alias("weighted"), F.sum("ov").alias("covered"))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends arriving cells to Parquet once each, then stops: for a scheduled run over what is new."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
