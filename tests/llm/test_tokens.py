"""Cuts for infilling, token files and alignment, against the libraries themselves and brute force."""

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandlake.llm import align, binary, infill, queries, segments
from strandlake.tables import shared_folder
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, DOCS, docs_of, words
from tests.llm.test_queries import DOCS as TABLE, SF, rows

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = [
    "a  b", "a  b", "é à  x", "x　 y", "don't 's  \t\n  end \n", " lead", "  two", "trail  ", "a▁ b", "▁", "x ▁y", "<|endoftext|> and<|endoftext|>", "\x1c \x1f x", "1 234 5.6 %%% a\n\nb\n c", "</s> <unk> <0x41>",
    "日本語 の テキスト。 次", "naïve ́combining", "zero\x00byte", "🙂 🙂🙂", "  line  sep", "﻿bom x", "​ z",
]


@lru_cache(maxsize=2)
def a_model(special=False):
    model = Tokenizer.from_file(A_PATH)
    model.encode_special_tokens = not special
    return model


@lru_cache(maxsize=1)
def b_model():
    return SentencePieceProcessor(model_file=B_PATH)


def a_encode(text, special=False):
    return a_model(special).encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def spelt():
    """Bytes of the ids of both sides, from the files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, k = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            byte[chr(256 + k)] = b
            k += 1
    a = {i: b"<|endoftext|>" if t == "<|endoftext|>" else bytes(byte[c] for c in t) for t, i in a_model().get_vocab().items()}
    names = [b_model().id_to_piece(i) for i in range(b_model().get_piece_size())]
    return a, [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode() for n in names]


def aligned(texts):
    a, b = spelt()
    return list(brute.alignment(texts, a_encode, lambda t: b_model().encode(t), a.__getitem__, b.__getitem__))


ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(rng, n):
    alphabet = [*"ab Z9.',\n\t ", "é", "à", " ", "▁", "世", "🙂", "  ", " the", " don't", "　", "\u0085", " ", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_segments_spell_the_text_and_encode_alike():
    """However texts are cut, the ids are those of the whole texts; long texts go in parts."""
    rng = random.Random(5)
    texts = HARD + random_texts(rng, 400) + [words(rng, 3000, 9000)]
    coder, other = segments.byte_level(A_PATH), segments.pieces(B_PATH)
    assert coder.cut and other.cut
    for special, front, limit in ((False, "", 1 << 20), (True, "", 64), (False, "", 64), (None, " ", 64)):
        coder = segments.byte_level(A_PATH, bool(special))
        table = None if special is None else coder.other
        for t in texts:
            got, back, spelling = [], [], b""
            for _, data, offsets, _ in segments.parcels(pa.array([front + t]), table, True, limit):
                _, place, keys = segments.distinct(data, offsets, table, True)
                ids = [np.frombuffer(x, np.uint32) for x in coder.encode(keys)]
                got += [i for p in place.tolist() for i in ids[p].tolist()]
                spelling += b"".join(keys[p] for p in place.tolist())
                if front and "▁" not in t:
                    ids = [np.frombuffer(x, np.uint32) for x in other.encode(keys)]
                    back += [i for p in place.tolist() for i in ids[p].tolist()]
            assert spelling == (front + t).encode() and got == a_encode(front + t, bool(special))
            assert not front or "▁" in t or not t or back == b_model().encode(t)


def test_distinct_segments_do_not_trust_hashes(monkeypatch):
    data, offsets = segments.utf8(pa.array(["one two one", "two three"]))
    want = segments.distinct(data, offsets, None, True)
    monkeypatch.setattr(segments, "span_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    got = segments.distinct(data, offsets, None, True)
    assert [want[2][i] for i in want[1]] == [got[2][i] for i in got[1]] == [b"one", b" two", b" one", b"two", b" three"]
    assert got[0].tolist() == want[0].tolist() == [3, 2]


def test_memo_forgets_but_answers():
    memo = segments.Memo(lambda keys: [k * 2 for k in keys], 8)
    rng = random.Random(1)
    for _ in range(50):
        keys = [b"%d" % i for i in rng.sample(range(40), 7)]
        assert memo(keys) == [k * 2 for k in keys]
    assert len(memo.young) + len(memo.old) <= 2 * (8 + 7)


def test_boundaries_select():
    rng = random.Random(2)
    for text in ["", " ", "a", " a", "a ", "a b  c\t", "é 世 🙂", words(rng, 5000), "x" * 3000 + " y", "a " * 4000] + random_texts(rng, 200):
        index = infill.Boundaries(text.encode())
        at, ends = 0, [0]
        for unit in re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text):
            at += len(unit.encode())
            ends.append(at)
        assert index.n == len(ends) - 1 and [index.select(i) for i in range(len(ends))] == ends


def test_boundaries_across_blocks(monkeypatch):
    text = words(random.Random(3), 400) + "   "
    want = infill.Boundaries(text.encode())
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(infill, "BLOCK_BYTES", size)
        got = infill.Boundaries(text.encode())
        assert got.n == want.n and [got.select(i) for i in range(got.n + 1)] == [want.select(i) for i in range(want.n + 1)]


def test_boundary_list_is_small():
    text = words(random.Random(3), 20000).encode()
    index = infill.Boundaries(text)
    assert (len(index.upper) + len(index.lower)) * 8 < index.n * (2 + np.log2(len(text) / index.n) + 1)


INFILL = [*AWKWARD, (None, "no key at all"), (None, None), (5, "one two three four five six"), (20, "has <P> in it"), (21, "<M>"), (22, "a<" * 50 + " P>"), *((100 + i, "the same text for many of them ") for i in range(300))]


@pytest.mark.parametrize("clash", [False, True])
def test_infill(spark, clash):
    df = docs_of(spark, INFILL, clash).withColumn("_output", F.lit(1)).repartition(5)
    out = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("_output"), F.col("_form")))
    got = out.collect()
    assert out.columns == [c for c in df.columns if c not in ("text", "_output")] + ["_n", "_form", "_prefix_chars", "_middle_chars", "_output", "back"]
    want = sorted((repr(d), *map(repr, brute.infill(d, t)), t or "") for d, t in INFILL)
    assert sorted((repr(r["doc_id"]), *(repr(r[c]) for c in ("_n", "_form", "_prefix_chars", "_middle_chars", "_output")), r["back"]) for r in got) == want


def test_infill_deals_a_common_text_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(infill, "COPIES", 16)
    monkeypatch.setattr(infill, "MANY_BITS", 8)
    df = docs_of(spark, INFILL).repartition(8)
    got = infill.fill_in_middle(df).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((repr(r["doc_id"]), r["_output"]) for r in got) == sorted((repr(d), brute.infill(d, t)[4]) for d, t in INFILL)
    assert len({r["task"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 100}) > 1


def test_infill_compares_bytes_of_equal_hashes(spark, monkeypatch):
    """With one hash for all texts each still has its own boundaries."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = infill.fill_in_middle(docs_of(spark, INFILL).repartition(4)).collect()
    assert sorted((repr(r["doc_id"]), r["_n"], r["_output"]) for r in got) == sorted((repr(d), brute.infill(d, t)[0], brute.infill(d, t)[4]) for d, t in INFILL)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert infill.fill_in_middle(none).collect() == [] and align.align(none, A_PATH, B_PATH).collect() == []
    out = shared_folder(spark)
    binary.write_ids(none, A_PATH, out)
    assert binary.documents(spark, out).collect() == []


TOKENS = [*AWKWARD, (None, "no key"), (None, None), (5, "one two three four five six"), (5, "another text, same key"), *((200 + i, t) for i, t in enumerate(HARD)), (900, words(random.Random(8), 9000, 5000)), (901, words(random.Random(9), 2047, 3))]


@pytest.mark.parametrize("clash", [False, True])
def test_token_files(spark, clash):
    out = shared_folder(spark)
    binary.write_ids(docs_of(spark, TOKENS, clash).repartition(3), A_PATH, out)
    got = binary.documents(spark, out).collect()
    ids = {}
    for d, t in TOKENS:
        ids.setdefault(-(1 << 63) if d is None else d, []).append([*a_encode(t or "", True), 0])
    told = lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted((r["key"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, *told(x)) for d, xs in ids.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["key"] for r in sorted(got, key=lambda r: r["start"])] == sorted(r["key"] for r in got)
    one = binary.read_ids(spark, out, [900])
    assert [i for r in sorted(one.collect(), key=lambda r: r["piece"]) for i in r["ids"]] == ids[900][0]
    assert "EqualTo(key,900)" in one._jdf.queryExecution().toString().replace(" ", "") or "In(key,[900])" in one._jdf.queryExecution().toString().replace(" ", "")


def test_token_files_in_parts(spark, monkeypatch):
    """A document over several rows, several parcels and several splits of a file keeps its place and its crc32."""
    out = shared_folder(spark)
    long = words(random.Random(8), 300000, 5000)
    binary.write_ids(docs_of(spark, [(1, long), (2, "after it")]).coalesce(1), A_PATH, out)
    parts = list(binary._fragments(iter([])))
    assert parts == []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r["key"]: r for r in binary.documents(spark, out).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = [*a_encode(long, True), 0]
    assert (got[1]["start"], got[1]["n_tokens"], got[1]["ids_crc32"]) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert (got[2]["start"], got[2]["n_tokens"]) == (len(ids), len(a_encode("after it")) + 1)


def test_joined_crc():
    rng = random.Random(4)
    for a, b in ((0, 0), (0, 9), (9, 0), (100, 70000), (5, 131072)):
        x, y = rng.randbytes(a), rng.randbytes(b)
        assert binary.crc32_joined(zlib.crc32(x), zlib.crc32(y), b) == zlib.crc32(x + y)


def test_files_have_stripes_an_index_and_filters(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(binary, "STRIPE_BYTES", 1 << 14)
    rng = random.Random(6)
    docs = docs_of(spark, [(i * 3, words(rng, 30)) for i in range(12000)])
    out = f"file://{tmp_path}/out"
    binary.write_ids(docs, A_PATH, out)
    files = sorted((tmp_path / "out/ids").glob("*.orc"))
    assert len(files) > 1
    stripes, ranges = 0, []
    for f in files:
        orc = pa.orc.ORCFile(f)
        stripes += orc.nstripes
        assert orc.row_index_stride == binary.INDEX_ROWS
        keys = orc.read(columns=["key"])["key"].to_pylist()
        ranges.append((keys[0], keys[-1]))
        assert keys == sorted(keys)
    assert stripes > len(files) and ranges == sorted(ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    opened = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(files[0])), reader.readerOptions(conf))
    kinds = {str(s.getKind()) for s in opened.rows().readStripeFooter(opened.getStripes()[0]).getStreamsList()}
    assert any(k.startswith("BLOOM_FILTER") for k in kinds) and "ROW_INDEX" in kinds


@pytest.mark.parametrize("clash", [False, True])
def test_alignment(spark, clash):
    docs = TOKENS[:-2] + [(i, t) for i, t in enumerate(random_texts(random.Random(3), 60))] + [(7, "the same words"), (7, "the same words")]
    names = ["doc_id", "a.b", "c0"] if clash else None
    out = align.align(docs_of(spark, docs, clash).repartition(3), A_PATH, B_PATH, keep=names)
    want = [(d, *w) for (d, _), w in zip(docs, aligned([t for _, t in docs]), strict=True)]
    assert out.columns == (names or ["doc_id"]) + ADDED
    assert sorted(((r["doc_id"], *(r[c] for c in ADDED)) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_in_parts(spark, monkeypatch):
    """Long texts over several parcels, sound and not, and ids dealt to several tasks, give what whole ones give."""
    rng = random.Random(12)
    long = words(rng, 220000, 300)
    docs = [(1, long), (2, long[:800000] + " ▁x"), (3, "w1 w2 w3"), (4, long[500000:]), *((i, words(rng, 30, 20)) for i in range(5, 60))]
    want = [(d, *w) for (d, _), w in zip(docs, aligned([t for _, t in docs]), strict=True)]
    for entries in (1 << 20, 8):
        got = align.align(docs_of(spark, docs).repartition(7), A_PATH, B_PATH, id_entries=entries).collect()
        assert sorted(tuple(r) for r in got) == want


def test_op12(spark):
    got, at = rows(spark, "op12_token_files"), 0
    for d, t in sorted(TABLE):
        ids = np.array([*a_encode(t or "", True), 0], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op13(spark):
    got = rows(spark, "op13_alignment")
    for (d, _), want in zip(TABLE, aligned([t for _, t in TABLE]), strict=True):
        assert tuple(got[d][c] for c in ADDED) == want


def test_op11(spark):
    got = rows(spark, "op11_infill")
    for d, t in TABLE:
        n, form, p, m, output = brute.infill(d, t)
        assert tuple(got[d][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) == (n, form, p, m, brute.sha(output), brute.sha(t or ""))
    assert set(queries.queries()) >= {"op11_infill", "op12_token_files", "op13_alignment"} and SF
