"""Fill-in-the-middle: seeded cuts of texts at token boundaries, from one boundary index for each distinct text.

Each map task bundles its documents by content: a row holds a text once and the documents that have it. Rows meet by a
hash of the text; there bytes are compared with those before, so that equal hashes are not taken for equal texts. The
boundaries of each distinct text are put in an Elias-Fano list once, its documents are joined to it, and each takes its
two boundaries by select. A text that very many documents have is dealt to several tasks, by bundle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.llm.common import arrow_map

#: Fixed values of the format: what stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and of those in which the suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
#: Documents of one text that go to one task, and the greatest number of texts that are dealt to several (as a power of 2).
COPIES, MANY_BITS = 1024, 18
#: Bytes of text whose boundaries are looked for together, and bytes of output of a batch.
BLOCK_BYTES, OUT_BYTES = 1 << 20, 1 << 22
#: Bits of the upper half of a list between two entries of its directory.
_STEP = 512


class Boundaries:
    """The ends of the tokens of a text, ascending byte places, as an Elias-Fano list: of each place the low bits are
    stored as they are, the rest as a bit vector in which the i-th set bit lies at (place >> bits) + i."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.n = sum(len(ends) for ends in _ends(data))
        self.bits = max(0, int(len(data) // max(1, self.n)).bit_length() - 1)
        upper = np.zeros(self.n + (len(data) >> self.bits) + 1, bool)
        lower = np.zeros((self.n, self.bits), bool)
        at = 0
        for ends in _ends(data):
            upper[(ends >> self.bits) + np.arange(at, at + len(ends))] = True
            for k in range(self.bits):
                lower[at : at + len(ends), k] = ends >> (self.bits - 1 - k) & 1
            at += len(ends)
        self.upper, self.lower = np.packbits(upper), np.packbits(lower)
        steps = np.arange(0, len(upper), _STEP)
        self.before = np.append(0, np.cumsum(np.add.reduceat(upper, steps, dtype=np.int64)))[:-1]

    def select(self, i: int) -> int:
        """Where the first i tokens end."""
        if not i:
            return 0
        i -= 1
        step = int(np.searchsorted(self.before, i, side="right")) - 1
        set_bits = np.flatnonzero(np.unpackbits(self.upper[step * _STEP // 8 : (step + 1) * _STEP // 8]))
        high = step * _STEP + int(set_bits[i - int(self.before[step])]) - i
        if not self.bits:
            return high
        first = i * self.bits
        own = np.unpackbits(self.lower[first // 8 : (first + self.bits + 7) // 8])[first % 8 : first % 8 + self.bits]
        return high << self.bits | int("".join(map(str, own.tolist())), 2)


def _ends(data: np.ndarray) -> Iterator[np.ndarray]:
    """Ends of tokens, block after block: each run of anything but white space, and white space at the end of the text."""
    for at in range(0, len(data), BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES + 1]
        space = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        if len(part) <= BLOCK_BYTES:  # the last block
            ends = np.append(~space[:-1] & space[1:], True)
        else:
            ends = ~space[:-1] & space[1:]
        yield np.flatnonzero(ends) + at + 1


def cut(text: bytes, index: Boundaries, key: str, seed: int, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of the prefix, of the middle, output) of one document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.select(first), index.select(second)
    chars = lambda part: int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < suffix_first:
        return "spm", chars(prefix), chars(middle), b"".join([s, suffix, p, prefix, m, middle])
    return "psm", chars(prefix), chars(middle), b"".join([p, prefix, s, suffix, m, middle])


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form. A text that holds a mark is never cut, so each mark is found where it was put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def _bundle(schema: T.StructType, columns: int):
    """Arrow batches (h, parts, text, columns) to (h, part, text, documents): a text of a batch once."""
    kind = to_arrow_type(schema["docs"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            h, texts = batch.column(0).to_numpy(), batch.column(2).cast(pa.binary())
            order = np.argsort(h, kind="stable")
            first = np.append(True, h[order][1:] != h[order][:-1])
            for i in np.flatnonzero(~first).tolist():  # bytes of equal hashes that follow one another
                if texts[int(order[i])].as_buffer() != texts[int(order[i - 1])].as_buffer():
                    first[i] = True
            begin = np.flatnonzero(first)
            stand = pa.array(order[begin])
            docs = pa.StructArray.from_arrays([c.take(pa.array(order)).cast(kind.field(i).type) for i, c in enumerate(batch.columns[3:])], fields=[kind.field(i) for i in range(columns)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), docs)
            parts = batch.column(1).to_numpy()[order[begin]]
            yield pa.RecordBatch.from_arrays([pa.array(h[order[begin]]), pa.array(((here + number) % parts).astype(np.int32)), batch.column(2).take(stand), lists], names=schema.names)

    return run


def _cuts(schema: T.StructType, columns: int, seed: int, rate: int, suffix_first: int):
    """Sorted rows (h, part, text, documents; a document's last column is its key as text) to its other columns, n, form,
    prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = None
        known: list[tuple[pa.Buffer, Boundaries]] = []
        docs: list[pa.Array] = []
        told: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own = pa.concat_arrays(docs).flatten()[:-1]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *made[:-1], made[-1].cast(pa.string())], names=schema.names)

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != who:
                    who, known = key, []
                raw = texts[i].as_buffer()
                index = next((x for t, x in known if t.equals(raw)), None)
                text = raw.to_pybytes()
                if index is None:
                    index = Boundaries(text)
                    known.append((pa.py_buffer(text), index))
                lists = batch.column(3).slice(i, 1).flatten()
                keys = lists.field(columns).to_pylist()
                done = 0
                for k, name in enumerate(keys):
                    told.append((index.n, *cut(text, index, name, seed, rate, suffix_first)))
                    size += len(text) + 64
                    if size >= OUT_BYTES:
                        docs.append(lists.slice(done, k + 1 - done))
                        yield flush()
                        docs, told, size, done = [], [], 0, k + 1
                if done < len(keys):
                    docs.append(lists.slice(done))
        if told:
            yield flush()

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns `keep` of docs (None: all but the text) with _n long (tokens), _form string (plain, psm or spm),
    _prefix_chars and _middle_chars long (code points; null if plain) and _output string; columns of docs with these names
    are replaced.

    Tokens are white space with the word behind it, and white space at the end. Two of the n + 1 boundaries are drawn by a
    hash of seed and key, as is the form. A null text is empty; a null key is drawn as the empty string; rows with one key
    and text are cut alike. Empty texts and those with one of the marks stay plain. An empty table gives no rows.
    """
    added = ["_n", "_form", "_prefix_chars", "_middle_chars", "_output"]
    kept = [c for c in (keep if keep is not None else docs.columns) if (keep is not None or c != text) and c not in added]
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("name")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = docs.select(F.xxhash64(whole).alias("h"))
    each = max(COPIES, docs.count() >> MANY_BITS)
    # Texts with more than `each` documents: no more than all documents divided by that, which is at most 2 ** MANY_BITS.
    many = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > each).select(F.col("h").alias("hot"), F.ceil(F.col("c") / each).cast("int").alias("p"))
    own = docs.select(F.xxhash64(whole).alias("h"), whole.alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), name)
    own = own.join(F.broadcast(many), F.col("h") == F.col("hot"), "left").select("h", F.coalesce("p", F.lit(1)).alias("parts"), "text", *own.columns[2:])
    document = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema.fields[3:]])
    bundle = T.StructType([T.StructField("h", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("docs", T.ArrayType(document))])
    bundles = arrow_map(own, _bundle(bundle, len(kept) + 1), bundle)
    n = max(own.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = bundles.repartition(n, "h", "part").sortWithinPartitions("h", "part")
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*document.fields[:-1], *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))])
    return arrow_map(met, _cuts(schema, len(kept), seed, rate, suffix_first), schema).toDF(*kept, *added)
