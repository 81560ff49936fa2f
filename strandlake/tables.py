"""Tables that cut lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch between Spark and a Python worker; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES: where the session has Spark's own bound it is lowered to that, since
    a batch of long rows is held several times, by Spark and by the worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver ends. Where that is unset, a session on one
    machine gets a temporary folder of its own; on a cluster it must be set, since executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
            held = context._jsc.sc().getCheckpointDir()
        root = held.get()
    path = f"{root.rstrip('/')}/strandlake-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a lost executor costs only the reread."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
