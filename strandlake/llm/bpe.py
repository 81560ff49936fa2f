"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import arrow_map, chunks

#: Texts longer than this many code points go to the library in pieces.
PIECE_CHARS = 1 << 16

#: Between a letter and a space or line break every match ends and the next one starts afresh, whatever surrounds
#: them: so a text may be cut there.
_SAFE = regex.compile(r"(?<=\p{L})(?=[ \n])")

#: Runs of Unicode white space that are taken apart from the library's matcher.
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The library's encoder for a rank file; one for each worker process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a long text at safe boundaries into pieces of `size` characters or up to the next such boundary."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The ids of a text.

    The library's matcher cannot take very long white space, so it is matched here: after a run of it the pattern starts
    afresh, before a word the run less its last character is one match, at the end the whole run.
    """
    enc = encoding(ranks_path, pattern)
    out: list[np.ndarray] = []

    def add(ids: list[int]) -> None:
        out.append(np.asarray(ids, dtype="<u4"))

    for p in pieces(text):
        at = 0
        for run in _SPACES.finditer(p):
            end = run.end() - (run.end() < len(p))
            add(enc.encode_ordinary(p[at : run.start()]))
            add(enc._encode_single_piece(p[run.start() : end]))
            at = end
        add(enc.encode_ordinary(p[at:]))
    return np.concatenate(out)


def decode_ids(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    enc = encoding(ranks_path, pattern)
    return b"".join(enc.decode_bytes(ids[at : at + PIECE_CHARS].tolist()) for at in range(0, len(ids), PIECE_CHARS))


def _coder(ranks_path: str, pattern: str, schema: T.StructType, keep: int, back: bool):
    """Arrow batches of `keep` columns and a text to those columns, n_tokens and ids, and with `back` decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(keep)):
                part = batch.slice(a, b - a)
                ids = [encode_text(x or "", ranks_path, pattern) for x in part.column(keep).to_pylist()]
                own = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if back:
                    own.append(pa.array([decode_ids(x, ranks_path, pattern) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *own], names=schema.names)

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """The columns `keep` of df (None: doc_id), n_tokens long, and ids binary: little-endian unsigned 32-bit integers.

    back: also `decoded` binary, what the ids decode to, in the same pass. A map without a shuffle; a null text counts
    as empty and has no ids; repeated rows give repeated rows. The rank file must be at ranks_path on every executor.
    """
    keep = keep or ["doc_id"]
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.BinaryType())] * back
    schema = T.StructType([*(df.schema[c] for c in keep), *more])
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return arrow_map(source, _coder(ranks_path, pattern, schema, len(keep), back), schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` binary, the raw bytes of the packed ids: no byte is replaced where a token splits a character."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(batch.schema.get_field_index(ids))):
                part = batch.slice(a, b - a)
                packed = part.column(batch.schema.get_field_index(ids)).to_pylist()
                raw = [decode_ids(np.frombuffer(x or b"", "<u4"), ranks_path, pattern) for x in packed]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=schema.names)

    return arrow_map(encoded, run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, n_tokens, ids binary, decoded binary; one pass."""
    return encode(df, ranks_path, pattern, text, keep, back=True)
