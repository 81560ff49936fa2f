"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by range of their key, sorted and encoded; one task writes one file, so files follow one another in
the order of the key. A row holds up to PIECE_IDS ids of one document, so that a reader's batch is bounded however long a
text is: (part, the file's number; ord, the document's number in it; key; piece; first, how many ids of the file come
before; n; last, whether the document ends here; ids). A small table beside them says how many ids each file has, from
which the place of each document among all ids follows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, integer_key
from strandlake.llm.segments import byte_level, distinct, parcels, ragged

#: Ids of a row.
PIECE_IDS = 2048
#: Bytes of a stripe before compression, rows of a group of the row index, false positives of a Bloom filter.
STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01

_ROW = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("ord", T.LongType()), T.StructField("key", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])
_FRAGMENT = "part int, ord long, key long, piece int, first long, n long, crc long"


def _encoder(path: str, special: bool, end_id: int):
    """Sorted (key, text) rows of one file to its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = byte_level(path, special)
        part, order, first, piece = TaskContext.get().partitionId(), 0, 0, 0
        held = np.zeros(0, np.uint32)  # ids of a long document that do not fill a row yet
        for batch in batches:
            keys = batch.column(0)
            for row, data, offsets, goes_on in parcels(batch.column(1), coder.other, coder.cut):
                per_row, place, segments = distinct(data, offsets, coder.other, coder.cut)
                packed = coder.memo(segments)
                pool = np.frombuffer(b"".join(packed), np.uint32)
                size = np.array([len(p) for p in packed], np.int64) // 4
                ids = pool[ragged((np.cumsum(size) - size)[place], size[place])] if len(place) else np.zeros(0, np.uint32)
                ends = np.append(0, np.cumsum(size[place]))[np.cumsum(per_row)] if len(place) else np.zeros(len(per_row), np.int64)
                if goes_on:
                    ids = np.concatenate([held, ids])
                    whole = len(ids) // PIECE_IDS * PIECE_IDS
                    held = ids[whole:].copy()
                    if whole:
                        count = np.full(whole // PIECE_IDS, PIECE_IDS)
                        yield _rows(part, np.full(len(count), order), keys[row].as_py(), piece + np.arange(len(count)), first, count, np.zeros(len(count), bool), ids[:whole])
                        piece, first = piece + len(count), first + whole
                    continue
                ids = np.concatenate([held, ids])
                ends = ends + len(held)
                begin = np.append(0, ends[:-1])
                ids = np.insert(ids, ends, end_id)
                total = ends - begin + 1
                rows_each = -(-total // PIECE_IDS)
                of = np.repeat(np.arange(len(total)), rows_each)
                inside = np.arange(len(of)) - np.repeat(np.cumsum(rows_each) - rows_each, rows_each)
                last = inside == rows_each[of] - 1
                count = np.where(last, total[of] - (rows_each[of] - 1) * PIECE_IDS, PIECE_IDS)
                yield _rows(part, order + of, keys.take(pa.array(row + of)), inside + np.where(of == 0, piece, 0), first, count, last, ids)
                order, first, piece, held = order + len(total), first + len(ids), 0, np.zeros(0, np.uint32)

    return run


def _rows(part: int, order: np.ndarray, keys: pa.Array | int, piece: np.ndarray, first: int, count: np.ndarray, last: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    own = pa.array(np.full(len(count), keys, np.int64)) if isinstance(keys, int) else keys
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids.astype(np.int32)))
    before = first + np.cumsum(count) - count
    columns = [np.full(len(count), part, np.int32), order.astype(np.int64), own, piece.astype(np.int32), before.astype(np.int64), count.astype(np.int32), last, lists]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_ROW.names)


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = 0, special: bool = True) -> None:
    """Writes the ids of every whole text, and end_id after each, in ascending order of the integer key, to ORC files in
    `out`/ids, and the number of ids of each file to `out`/files.

    A null text is empty and has end_id alone; a null key counts as the smallest long. Rows with one key are all written,
    ordered by a hash of the text. special: strings of special tokens inside texts become these tokens, as the library
    does unless told otherwise. An empty table gives no rows. The tokenizer's file must be on every executor.
    """
    spark = docs.sparkSession
    own = docs.select(integer_key(docs, key).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = max(own.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The last two keep many rows of one key, and many copies of one row, from going to one task.
    by = own.withColumns({"t": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    dealt = by.repartitionByRange(n, "key", "t", "m").sortWithinPartitions("key", "t", "m").select("key", "text")
    settings = {
        "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(INDEX_ROWS), "orc.create.index": "true", "orc.rows.between.memory.checks": "200",
        "orc.bloom.filter.columns": "key", "orc.bloom.filter.fpp": str(FALSE_POSITIVES),
    }
    arrow_map(dealt, _encoder(tokenizer_path, special, end_id), _ROW).write.options(**settings).orc(f"{out}/ids")
    rows = spark.read.schema(_ROW).orc(f"{out}/ids")
    rows.groupBy("part").agg(F.sum("n").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).write.parquet(f"{out}/files")


def file_starts(spark: SparkSession, out: str) -> DataFrame:
    """(part, start): how many ids all files before have; one row for each file, whose list the driver holds anyway."""
    files = spark.read.parquet(f"{out}/files").select("part", "n").orderBy("part").collect()
    totals = np.cumsum([0, *(r["n"] for r in files)]).tolist()
    return spark.createDataFrame([(r["part"], t) for r, t in zip(files, totals, strict=False)], "part int, start long")


def read_ids(spark: SparkSession, out: str, keys: list[int] | None = None) -> DataFrame:
    """(key, part, ord, piece, first, n, last, ids) from the files. keys: of these documents only; stripes and groups of
    rows whose statistics or Bloom filters exclude them are not read, nor files beyond their range."""
    rows = spark.read.schema(_ROW).orc(f"{out}/ids")
    return rows if keys is None else rows.where(F.col("key").isin(keys))


def crc32_joined(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings one after another, from theirs and the second's size."""
    zeros = bytes(min(size, 1 << 16))
    shifted, plain = first, 0
    for at in range(0, size, 1 << 16):
        part = zeros[: size - at]
        shifted, plain = zlib.crc32(part, shifted), zlib.crc32(part, plain)
    return shifted ^ plain ^ second


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of files to one row for each document, or for each part of it that a split of a file holds: its crc32."""
    who, crc, begin = None, 0, (0, 0, 0)
    names = ["part", "ord", "key", "piece", "first", "n", "crc"]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        part, order, key, piece, first, lists = (batch.column(i) for i in range(6))
        raw = lists.flatten().to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.diff(lists.offsets.to_numpy()))
        at = 0
        for p, o, k, i, f, end in zip(part.to_pylist(), order.to_pylist(), key.to_pylist(), piece.to_pylist(), first.to_pylist(), ends.tolist(), strict=True):
            if who != (p, o):
                if who:
                    out.append((*who, *begin, size // 4, crc))
                who, begin, crc, size = (p, o), (k, i, f), 0, 0
            crc, size = zlib.crc32(raw[at:end], crc), size + end - at
            at = end
        if len(out) >= 1 << 14:
            yield flush()
            out.clear()
    if who:
        out.append((*who, *begin, size // 4, crc))
    if out:
        yield flush()


def _joined(parts: Column) -> Column:
    """crc32 of a document from its parts in order: almost always one, else as many as splits of files hold some of it."""

    @F.udf("long")
    def several(rows):
        crc = 0
        for r in rows or ():
            crc = crc32_joined(crc, r["crc"], 4 * r["n"])
        return crc if rows else None

    return F.coalesce(several(F.when(F.size(parts) > 1, parts)), parts[0]["crc"])


def documents(spark: SparkSession, out: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the files: where its ids start among all ids,
    how many they are with the end id, and the crc32 of all of them as little-endian unsigned 32-bit integers."""
    rows = read_ids(spark, out).select("part", "ord", "key", "piece", "first", "ids")
    found = arrow_map(rows, _fragments, _FRAGMENT)
    each = found.groupBy("part", "ord", "key").agg(F.array_sort(F.collect_list(F.struct("piece", "first", "n", "crc"))).alias("parts"))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    told = each.select("part", "key", F.col("parts")[0]["first"].alias("first"), n.alias("n_tokens"), _joined(F.col("parts")).alias("ids_crc32"))
    placed = told.join(file_starts(spark, out), "part")
    return placed.select("key", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
