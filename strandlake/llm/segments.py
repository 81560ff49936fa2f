"""Texts cut where a tokenizer starts afresh whatever stands around, so that each distinct segment is encoded once.

A cut lies before a space that follows anything but white space, and with a table `other` also before such a line break
and between an ASCII letter and an ASCII character of the table, which is no letter. A byte-level tokenizer that matches words with one leading
space ends a match at all of these; a piece model without pieces that hold a space behind another character at the first
kind. For other models `cut` is False and whole texts are segments.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from strandlake.llm.common import chunks, prefix_sums, span_hash, utf8

#: Bytes of text whose segments are looked up together; a longer text goes in parts that end at cuts.
PARCEL_BYTES = 1 << 21
#: Segments that a worker remembers, twice over, and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 18, 64


def cuts(data: np.ndarray, other: np.ndarray | None) -> np.ndarray:
    """Places in data before which a text may be cut. White space beyond ASCII, and U+2581, count as white space. other: a
    table of the bytes before which a text may be cut behind a letter; with it also line breaks count."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A) if other is not None else data == 0x20)
    at = at[at > 0]
    last = data[at - 1]
    before = np.where(at > 1, data[at - 2], 0)
    wide = ((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (before == 0x9A) | (before == 0x80) | (before == 0x81) | ((before == 0x96) & (last == 0x81))
    at = at[((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & ~wide)]
    if other is None:
        return at
    word = np.flatnonzero(_LETTER[data[:-1]] & other[data[1:]]) + 1
    return _merged(at, word)


_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_OTHER = ~_LETTER & (np.arange(256) < 0x80)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The different numbers of both, in order."""
    both = np.sort(np.concatenate([a, b]))
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def parcels(column: pa.Array, other: np.ndarray | None, cut: bool, limit: int = PARCEL_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, offsets, whether the row goes on): several whole rows, or a part of one long row."""
    for a, b in chunks(column, limit):
        data, offsets = utf8(column.slice(a, b - a))
        while cut and len(data) > limit and b == a + 1:
            reach = 2 * limit
            found = cuts(data[:reach], other)
            while not len(found) and reach < len(data):
                reach *= 2
                found = cuts(data[:reach], other)
            inside = found[found <= limit]
            end = int(inside[-1]) if len(inside) else int(found[0]) if len(found) else len(data)
            if end == len(data):
                break
            yield a, data[:end], np.array([0, end]), True
            data = data[end:]
            offsets = np.array([0, len(data)])
        yield a, data, offsets, False


def distinct(data: np.ndarray, offsets: np.ndarray, other: np.ndarray | None, cut: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of segments of each row, their places in the list, the different segments). Equal hashes are not trusted:
    every segment is compared with the one that stands for it."""
    inner = cuts(data, other) if cut else np.zeros(0, np.int64)
    starts = _merged(offsets[:-1][np.diff(offsets) > 0], inner)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    per_row = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    if not len(starts):
        return per_row, starts, []
    _, first, place = np.unique(span_hash(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    raw = data.tobytes()
    twin = first[place]
    same = (size[twin] == size).all() and (data[np.repeat(starts[twin] - starts, size) + np.arange(len(data))] == data).all()
    if not same:
        number: dict[bytes, int] = {}
        place = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return per_row, place, list(number)
    return per_row, place, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]


class Memo:
    """Values of segments, made for many at once; the last `limit` new ones and those before them are kept."""

    def __init__(self, make: Callable[[list[bytes]], list], limit: int = REMEMBERED):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __call__(self, keys: list[bytes]) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        new = []
        for i, value in enumerate(out):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    new.append(i)
                else:
                    out[i] = young[keys[i]] = value
        if new:
            for i, value in zip(new, self.make([keys[i] for i in new]), strict=True):
                out[i] = value
                if len(keys[i]) <= LONGEST:
                    young[keys[i]] = value
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of all rows, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library. special: strings of special tokens in a text become those."""

    def __init__(self, path: str, special: bool):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        split = described["pre_tokenizer"] or {}
        self.cut = described["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", False) and not split.get("add_prefix_space", True)
        # Byte-level entries spell a byte below 0x21, 0x7F to 0xA0 and 0xAD as a character from U+0100 on, in this order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in set(plain)]
        spelt = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(moved)}
        byte = {c: b for b, c in spelt.items()}
        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.entry = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            self.entry[i] = token.encode() if token in added else bytes(byte[c] for c in token)
        self.size = np.array([len(e) for e in self.entry], np.int64)
        self.memo = Memo(self.encode, 2 * REMEMBERED)  # as long as the worker lives, over its tasks
        # Where special tokens are looked for in a text, none of them may be cut.
        self.other = _OTHER.copy()
        for t in added if special else ():
            self.cut &= not set(t) & set(" \n")
            self.other[[b for a, b in zip(t.encode(), t.encode()[1:], strict=False) if _LETTER[a] and _OTHER[b]]] = False

    def encode(self, segments: list[bytes]) -> list[bytes]:
        """Ids of each segment as packed 32-bit integers. Those between which a cut lies are encoded as one text."""
        out = [b""] * len(segments)
        joined, alone = [], []
        for i, s in enumerate(segments):
            (joined if self.cut and s[0] in b" \n" and 0x20 < s[-1] < 0x7F else alone).append(i)
        for at in range(0, len(joined), 4096):
            some = joined[at : at + 4096]
            ids = self._ids([b"".join([segments[i] for i in some])])[0]
            ends = 4 * np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(segments[i]) for i in some]), side="left") + 4
            raw, at = ids.tobytes(), 0
            for i, end in zip(some, ends.tolist(), strict=True):
                out[i] = raw[at:end]
                at = end
        for i, ids in zip(alone, self._ids([segments[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        return out

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; a segment begins with the space that the model itself adds."""

    def __init__(self, path: str):
        import re

        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cut = not any(re.search("[^▁]▁", n) for n in names) and self.model.encode("a  b ") == self.model.encode("a") + self.model.encode(" b ")
        self.space = self.model.encode("a ")[len(self.model.encode("a")) :]  # of a space at the end
        self.entry = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size = np.array([len(e) for e in self.entry], np.int64)

    def encode(self, segments: list[bytes]) -> list[bytes]:
        ids = self.model.encode([s[1:].decode() for s in segments], num_threads=1)
        return [np.array(self.space if s == b" " else x, np.uint32).tobytes() for s, x in zip(segments, ids, strict=True)]


@lru_cache(maxsize=4)
def byte_level(path: str, special: bool = False) -> ByteLevel:
    """One for each worker process."""
    return ByteLevel(path, special)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)
