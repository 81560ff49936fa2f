"""Each training-data operator on awkward small tables: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns with clashing names."""

import collections
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, chat, common, decontaminate, fingerprint, quality, sharding, simhash, suffix_dedup, toxicity, url_filter
from tests.llm import brute

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, rows, more=False):
    df = spark.createDataFrame(rows, DOCS)
    clash = (
        "_text", "_key", "_doc", "_t", "part", "shard", "slot", "_score", "h", "fp", "node", "lanes", "_scored_text", "_later", "_later_id", "_kept", "_spans", "_found", "doc", "t", "_list", "c0", "c1",
        "_n_words", "_hit_spans", "_item_ids", "_h", "_p", "_won", "_host", "_path", "_placed", "_shard", "_grown", "a.b",
    )
    return df.select("*", *(F.lit("x").alias(c) for c in clash)) if more else df


AWKWARD = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "Ünïcode É́ naïve"), (5, "one two three four five six"), (6, "one two three four five six"), (9, "x" * 300), (-7, "tab\tand\nline"), (12, "🙂🙂 " * 40)]


def test_every_operator_takes_clashing_columns(spark):
    """All columns go in and come out; those named like a result are replaced by it."""
    df = docs_of(spark, AWKWARD, True)
    names, n = df.columns, len(AWKWARD)
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "far other words")], "item_id long, text string")
    machine = toxicity.train(df, spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, toxic int"))
    for out, added in (
        (sharding.assign_shards(df, 3), ["_shard", "_grown"]),
        (toxicity.score(df, machine), ["_score"]),
        (suffix_dedup.remove_repeats(df), ["_kept", "_spans"]),
        (decontaminate.decontaminate(df, items), ["_n_words", "_hit_spans", "_item_ids"]),
        (url_filter.judge(df, spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string"), "text"), ["_host", "_path", "_rule", "_verdict"]),
    ):
        rows = out.collect()
        gone = ["text"] if "_kept" in added else []
        assert out.columns == [c for c in names if c not in added + gone] + added and len(rows) == n
        assert sorted((r["doc_id"], r["a.b"], r["c0"], r["lanes"]) for r in rows) == sorted((d, "x", "x", "x") for d, _ in AWKWARD)
    for out, left in ((toxicity.reject(df, machine, threshold=2.0), n), (simhash.drop_near_duplicates(df), n - 3), (suffix_dedup.without_repeats(df), n), (decontaminate.clean(df, items), n - 2)):
        rows = out.collect()
        assert out.columns == names and len(rows) == left and {tuple(v for c, v in r.asDict().items() if c not in ("doc_id", "text")) for r in rows} == {("x",) * (len(names) - 2)}
    for ordered in (suffix_dedup.remove_repeats, simhash.near_groups):
        with pytest.raises(TypeError):
            ordered(df, key="h")


# sharding


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in sharding.shard_manifest(df, 5).collect()}
    want = {r["doc_id"]: brute.jump(r["h"], 5) if r["doc_id"] else 0 for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert {k: r["shard"] for k, r in got.items()} == want


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *random.Random(1).sample(range(10**12), 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 97):
        got = {r["k"]: r for r in df.select("k", sharding.jump_hash(F.col("k"), n, n + 1).alias("p")).collect()}
        for k in keys:
            assert (got[k]["p"][f"n{n}"], got[k]["p"][f"n{n + 1}"]) == (brute.jump(k, n), brute.jump(k, n + 1))


def test_shard_manifest(spark):
    rows = AWKWARD + [(5, "one two three four five six")] * 50 + [(None, "z")] * 3
    got = sharding.shard_manifest(docs_of(spark, rows, True), 3).collect()
    assert len(got) == len(rows)
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), brute.jump(d or 0, 3), brute.jump(d or 0, 4)) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    assert sharding.shard_manifest(docs_of(spark, []), 3).collect() == []


def test_write_shards(spark, tmp_path):
    df = docs_of(spark, AWKWARD, True)
    sharding.write_shards(df, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(AWKWARD) and "_shard" in back.columns


# byte-level BPE


def test_bpe_round_trip_and_library(spark):
    rng = random.Random(2)
    rows = AWKWARD + [(20, words(rng, 30000)), (21, "b" * 70000 + " c" * 50), (22, "don't 'll <|endoftext|> \u2028 x" * 9), (23, " " * 3000)]
    enc = bpe.encoding(RANKS, P.PATTERN)
    for r in bpe.round_trip(docs_of(spark, rows, True), RANKS, P.PATTERN).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == enc.encode_ordinary(text) and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
    assert bpe.round_trip(docs_of(spark, []), RANKS, P.PATTERN).collect() == []
    coded = bpe.encode(docs_of(spark, [(1, "é")]), RANKS, P.PATTERN)
    assert bytes(bpe.decode(coded, RANKS, P.PATTERN).first()["decoded"]) == "é".encode()


def test_bpe_long_white_space():
    """Runs that the library's matcher takes as they are, and such as it does not, up to a million."""
    rng, enc = random.Random(23), bpe.encoding(RANKS, P.PATTERN)
    space = " \t\n\r\v\f\x85\xa0\u1680\u2000\u2028\u202f\u205f\u3000"
    for _ in range(200):
        runs = ("".join(rng.choice(" " if rng.random() < 0.5 else space) for _ in range(rng.choice([0, 1, 2, 999, 1000, 1001, 1500]))) for _ in range(6))
        text = "".join(rng.choice(["ab", "c1", "#!", " x", "'s", "é", "\x1c", "\u200b", ""]) + run for run in runs)
        assert bpe.encode_text(text, RANKS, P.PATTERN).tolist() == enc.encode_ordinary(text), repr(text)
    for c in (" ", "\n", "b", "7", "\u0301", "#"):
        for text in (c * 1_000_000, f"a{c * 1_000_000}b"):
            ids = bpe.encode_text(text, RANKS, P.PATTERN)
            assert bpe.decode_ids(ids, RANKS, P.PATTERN) == text.encode()
            one = enc._encode_single_piece
            if c == " ":
                assert ids.tolist() == (one(text) if text[0] == c else one("a") + one(c * 999_999) + one(" b"))


def test_bpe_pieces_join():
    text = "word, other\n\n 12 " * 50
    cut = list(bpe.pieces(text, 64))
    enc = bpe.encoding(RANKS, P.PATTERN)
    assert "".join(cut) == text and len(cut) > 5
    assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# chat

EVENTS = "conv string, seq long, msg string, kind string, role string, text string"


def test_fold(spark):
    log = [
        ("c", 1, "u", "message", "user", "hi"), ("c", 2, "a", "message", "assistant", ""), ("c", 3, "a", "delta", None, "he"), ("c", 4, "a", "delta", None, "llo"), ("c", 4, "a", "delta", None, "llo"),
        ("c", 5, "v", "message", "user", "again"), ("c", 6, "u", "edit", None, "hey"), ("c", 7, "a", "regenerate", None, None), ("c", 8, "a", "delta", None, "new"), ("c", 9, "w", "message", "user", "bye"),
        ("d", 1, "x", "delta", "assistant", "lone"), (None, 1, "y", "message", None, None),
    ]
    got = [tuple(r) for r in chat.fold(spark.createDataFrame(log, EVENTS)).orderBy("conv", "at").select("conv", "msg", "role", "text").collect()]
    assert got == [(None, "y", "", ""), ("c", "u", "user", "hey"), ("c", "a", "assistant", "new"), ("c", "w", "user", "bye"), ("d", "x", "assistant", "lone")]


def test_streamed_log_folds_to_the_same(spark):
    rows = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate([("user", "hi"), ("assistant", "a"), ("assistant", ""), ("system", None), ("assistant", "é🙂 long answer")])]
    own = chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    log = chat.streamed(own)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    plain, folded = ([tuple(r) for r in chat.fold(x).orderBy("conv", "msg").select("conv", "msg", "role", "text").collect()] for x in (own, log))
    assert plain == folded and len(plain) == len(rows)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "&lt;| &amp; <", "<", "|", "", None, "a\nb<|im_end|>\n", "é<|"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(6) for t, r in enumerate(["user", "assistant", "sys\ntem", "assistant"])]
    rows += [(0, 1, "assistant", "tie")] + [(7, None, "user", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    out = chat.render(chat.fold(chat.turn_events(df)))
    for r in out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect():
        own = sorted((x for x in rows if x[0] == r["conv"]), key=lambda x: (x[1] if x[1] is not None else -1, x[2], x[3] or ""))
        assert [tuple(t) for t in r["turns"]] == [(x[2], x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant") and r["n_turns"] == len(own)
    assert chat.render(chat.fold(chat.turn_events(df.limit(0)))).collect() == []


# fingerprints


def test_fingerprint_classes(spark):
    rows = AWKWARD + [(30, "Cafe\u0301  Straße"), (31, "CAFÉ STRASSE "), (32, "\u1100\u1161\u11a8"), (33, "각"), (34, "a\u0323\u0301"), (35, "a\u0301\u0323")]
    got = {r[0]: r[1] for r in fingerprint.fingerprint(docs_of(spark, rows, True)).collect()}
    for a, x in rows:
        for b, y in rows:
            assert (got[a] == got[b]) == (brute.canonical(x) == brute.canonical(y)), (x, y)
    assert fingerprint.fingerprint(docs_of(spark, [])).collect() == []


def test_compose_is_nfc(spark):
    """Random bases with up to five marks, of all blocks, and Hangul, Indic, Tibetan, Hebrew and Arabic among them."""
    rng = random.Random(24)
    assigned = [c for c in map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x30000)]) if unicodedata.category(c) != "Cn"]
    marks = [c for c in assigned if unicodedata.combining(c)]
    bases = [c for c in assigned if unicodedata.decomposition(c)] + [*"aeEo", *(chr(c) for c in [*range(0x5D0, 0x5EB), *range(0x621, 0x64B), *range(0x900, 0xE00), *range(0xF00, 0xFC0), *range(0x1100, 0x1200)])]
    texts = ["".join(rng.choice(bases) + "".join(rng.choice(marks) for _ in range(rng.randrange(6))) for _ in range(3)) for _ in range(12_000)]
    texts += ["E\u0319\u0301", "\u0644\u05ad\u0652", "\u1100\u1161\u11a8", "plain", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", fingerprint.compose(F.col("t")).alias("c")).collect()}
    assert all(got[i] == unicodedata.normalize("NFC", t) for i, t in enumerate(texts))
    assert "Python" not in df.select(fingerprint.canonical(F.col("t")))._jdf.queryExecution().toString()


def test_fingerprint_tells_colliding_texts_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.lit("same"))
    rows = [(1, "a"), (2, "b"), (3, "A "), (4, "c")]
    got = {r[0]: r[1] for r in fingerprint.fingerprint(docs_of(spark, rows)).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 3


@pytest.mark.parametrize("size", [1, 2, 3, 2000])
def test_beside_next(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
    rows = [(7 * i * i - 50, f"text {i}" * i) for i in range(12)] + [(10**15, "far")]
    got = {r["key"]: r for r in fingerprint.beside_next(docs_of(spark, rows, True))(None).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        assert (got[d]["text"], got[d]["next_text"], got[d]["next_key"]) == (t, nxt[1], nxt[0])


def test_ordered_parts_are_even(spark, monkeypatch):
    """A far key, a key that a third of the rows share, and rows without a key leave no large part, and parts in order."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 50)
    rng = random.Random(25)
    rows = [(rng.randrange(10**6), f"a{i}") for i in range(3000)] + [(2**62, "far"), (-(2**62), "near")] + [(77, f"b{i}") for i in range(2000)] + [(None, f"c{i}") for i in range(1000)]
    own = docs_of(spark, rows).select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie"))
    got = [(r["part"], r["key"] is not None, r["key"] or 0, r["tie"]) for r in fingerprint.ordered_parts(own).collect()]
    assert len(got) == len(rows) and max(collections.Counter(r[0] for r in got).values()) <= 150
    parts = [r[0] for r in sorted(got, key=lambda r: r[1:])]
    assert parts == sorted(parts)
    assert fingerprint.ordered_parts(own.limit(0)).collect() == []


def test_beside_next_shared_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    rows = [(5, f"x{i}") for i in range(20)] + [(None, f"n{i}") for i in range(10)] + [(i, f"t{i}") for i in range(10)]
    got = [(r["text"], r["next_text"]) for r in fingerprint.beside_next(docs_of(spark, rows, True))(None).collect()]
    assert len(got) == len(rows) and sorted(a for a, _ in got) == sorted(b for _, b in got) == sorted(t for _, t in rows)
    after = dict(got)
    assert after["t9"] == "t8" and after["t0"].startswith("n") and {a for a, b in got if b == "t9"} <= {f"n{i}" for i in range(10)}


# quality


def test_largest_is_exact(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.choice([rng.random(), 0.5]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double")
    for k in (0, 1, 700, 1500, 2999, 3000, 5000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        assert sorted(r["id"] for r in quality.largest(df, k, "v", "id").collect()) == sorted(r[0] for r in want)


def test_largest_among_copies(spark, monkeypatch):
    """More rows with one key than a task sorts."""
    monkeypatch.setattr(quality, "FEW", 50)
    rows = [(i, float(i)) for i in range(300)] + [(1000, 150.5)] * 400
    df = spark.createDataFrame(rows, "id long, v double")
    for k in (100, 149, 150, 400, 549, 550, 699):
        want = sorted(rows, key=lambda r: -r[1])[:k]
        assert sorted(r["id"] for r in quality.largest(df, k, "v", "id").collect()) == sorted(r[0] for r in want)


def test_buckets_grow_with_the_texts():
    sizes = [quality.buckets_for(n) for n in (0, 1, quality.BUCKET_BYTES, quality.BUCKET_BYTES + 1, 10**9, 3 * 10**10, 10**14)]
    assert sizes[:4] == [quality.BUCKETS] * 3 + [2 * quality.BUCKETS] and sizes == sorted(sizes) and sizes[5:] == [1 << 19, 1 << 25]


@pytest.mark.parametrize(("bucket_bytes", "broadcast_bytes"), [(quality.BUCKET_BYTES, quality.BROADCAST_BYTES), (100, 0)])
def test_resample_by_hand(spark, monkeypatch, bucket_bytes, broadcast_bytes):
    """Counts, log weights, noise and the draw in plain Python; with buckets by the size of the texts, and ids that are
    too large to broadcast."""
    monkeypatch.setattr(quality, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(26)
    rows = [(i, words(rng, rng.randrange(30), 20) + rng.choice(["", " ... !", " É x"])) for i in range(120)] + [(500, None), (501, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(7, None)]
    buckets = quality.buckets_for(sum(len((t or "").encode()) for _, t in rows))
    assert (buckets > quality.BUCKETS) == (bucket_bytes == 100)
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\t-\r 0-9A-Za-z\x80-\xff]+")

    def grams(text):
        found = token.findall((text or "").lower().encode())
        one = [common.span_hash(common.prefix_sums(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)])) for x in found]
        two = [common.mix(a * np.uint64(0xD6E8FEB86659FD93) + b) for a, b in zip(one, one[1:], strict=False)]
        return [int(h[0] % np.uint64(buckets)) for h in one + two]

    raw, target = collections.Counter(), collections.Counter()
    for d, t in rows:
        raw.update(grams(t))
        if dict(labels).get(d) == 1:
            target.update(grams(t))
    size = lambda c: sum(c.values()) + buckets
    weight = {d: sum(np.log((target[g] + 1) / size(target)) - np.log((raw[g] + 1) / size(raw)) for g in grams(t)) for d, t in rows}
    hashes = {r["doc_id"]: r["h"] for r in docs_of(spark, rows).select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()}
    noisy = {d: w - np.log(-np.log(((hashes[d] % 2**64 >> 11) + 0.5) / 2**53)) for d, w in weight.items()}
    k = round(20 / 60 * len(rows))
    got = {r["doc_id"]: r for r in quality.resample(docs_of(spark, rows, True), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert set(got) == set(sorted(noisy, key=lambda d: -noisy[d])[:k])
    assert all(abs(r["log_weight"] - weight[d]) < 1e-6 and abs(r["gumbel_key"] - noisy[d]) < 1e-6 for d, r in got.items())


def test_resample_prefers_target(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60) if i % 2 else " ".join("#$% @@!" for _ in range(40))) for i in range(200)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, None), (5000, 1)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.resample(docs_of(spark, rows, True), labels).collect()}
    good, bad = {i for i in range(200) if i % 2}, {i for i in range(200) if not i % 2}
    assert len(kept & good) >= 98 and len(kept & bad) <= 3
    assert quality.resample(docs_of(spark, rows), labels.limit(0)).collect() == []
    assert quality.resample(docs_of(spark, []), labels).collect() == []


# toxicity


def test_toxicity_needs_the_pair(spark):
    """An insult or a group alone is harmless; both together are not: no sum of single weights tells them apart well."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        insult, group = i % 2, i // 2 % 2
        rows.append((i, f"{words(rng, 20, 60)} {'vile' * insult} {words(rng, 10, 60)} {'martians' * group}"))
        labels.append((i, insult * group))
    train = spark.createDataFrame(labels[:800], "doc_id long, toxic int")
    df = docs_of(spark, rows, True)
    machine = toxicity.train(df, train)
    scores = {r["doc_id"]: r["_s"] for r in toxicity.score(docs_of(spark, rows), machine, keep=["doc_id"]).withColumnRenamed("_score", "_s").collect()}
    right = sum((scores[i] >= 0.5) == bool(y) for i, y in labels[800:])
    assert right / 400 > 0.97
    assert np.abs(machine.vectors[:-1]).max() > 0.1


def test_machine_is_the_plain_sum():
    """Scores against the sum over all pairs, gradients against differences."""
    rng = np.random.default_rng(3)
    m, k = 7, 3
    w, v = rng.normal(size=m + 1), rng.normal(size=(m + 1, k))
    bags = [np.array(b, np.int64) for b in ([0, 2, 5], [1], [], [0, 1, 2, 3, 4, 5, 6])]
    row, feature = np.repeat(np.arange(4), [len(b) for b in bags]), np.concatenate(bags)
    y = np.array([1.0, 0, 1, 0])

    def plain(w, v):
        total = [w[m] + sum(w[i] for i in b) + sum(v[i] @ v[j] for x, i in enumerate(b) for j in b[x + 1 :]) for b in bags]
        return 1 / (1 + np.exp(-np.array(total)))

    assert np.allclose(toxicity.Machine(np.zeros(1), w, v).scores(row, feature, 4), plain(w, v))
    loss = lambda w, v: -np.mean(y * np.log(plain(w, v)) + (1 - y) * np.log(1 - plain(w, v)))
    dw, dv = toxicity.gradient(w, v, row, feature, y)
    for i in range(m + 1):
        step = np.eye(m + 1)[i] * 1e-6
        assert abs((loss(w + step, v) - loss(w - step, v)) / 2e-6 - dw[i]) < 1e-6
        for f in range(k if i < m else 0):
            move = np.outer(step, np.eye(k)[f])
            assert abs((loss(w, v + move) - loss(w, v - move)) / 2e-6 - dv[i, f]) < 1e-6


def test_sample_is_bounded(spark):
    """One labelled id with a great many rows sends no more rows to the driver than asked for."""
    rows = [(1, f"copy {i}") for i in range(2000)] + [(1, "same")] * 500 + [(2, "other")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    bags, y = toxicity.sample(docs_of(spark, rows), labels, "doc_id", "text", "toxic", 10)
    assert len(bags) == len(y) == 10


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, None), (77, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs_of(spark, AWKWARD), labels.limit(0))
    got = toxicity.score(docs_of(spark, AWKWARD), machine).collect()
    assert {r["_score"] for r in got} == {0.5} and len(got) == len(AWKWARD)
    assert 0 < toxicity.score(docs_of(spark, [(1, "")]), toxicity.train(docs_of(spark, AWKWARD), labels)).first()["_score"] < 1
    assert toxicity.score(docs_of(spark, []), machine).collect() == []


# suffix-array dedup


def test_longest_previous_factors():
    rng = random.Random(9)
    for _ in range(20):
        s = "".join(rng.choice("ab") for _ in range(30))
        order = sorted(range(30), key=lambda i: s[i:])
        common = lambda i, j: next((k for k in range(30) if s[i + k : i + k + 1] != s[j + k : j + k + 1] or i + k >= 30), 30)
        lcp = [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
        want = [max([common(i, j) for j in range(i)], default=0) for i in range(30)]
        assert suffix_dedup.longest_previous_factors(np.array(order), np.array(lcp)).tolist() == want


def test_equal_windows_are_long_previous_factors():
    rng = random.Random(18)
    for _ in range(20):
        s, length = "".join(rng.choice("ab") for _ in range(60)), 5
        order = sorted(range(60), key=lambda i: s[i:])
        common = lambda i, j: next((k for k in range(60) if s[i + k : i + k + 1] != s[j + k : j + k + 1] or i + k >= 60), 60)
        factors = suffix_dedup.longest_previous_factors(np.array(order), np.array([0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]))
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(s.encode(), np.uint8), length)
        assert suffix_dedup.repeated_windows(windows, np.arange(len(windows))).tolist() == (factors[: len(windows)] >= length).tolist()


def repeated_rows(rng):
    passage, other = words(rng, 60), words(rng, 40)
    rows = [(i, f"{words(rng, 30)} {passage[rng.randrange(40):]} {words(rng, 5)} {other if i % 3 else ''}") for i in range(30)]
    rows += [(100, rows[3][1]), (101, "ab" * 400), (102, "z" * 99), (103, "\0" * 300), (104, passage + passage), (105, "é" * 120), (106, "x" + "é" * 120)]
    return rows + [(200 + i, t) for i, t in AWKWARD if i >= 0]


@pytest.mark.parametrize("name, value", [("FLUSH", 50), ("FLUSH", 1 << 17), ("CROWDED", 1), ("CROWDED", 3), ("HELD", 20), ("SORT_BYTES", 400), ("BLOCK_BYTES", 256)])
def test_remove_repeats(spark, monkeypatch, name, value):
    """Whatever goes together, is held at once, or is filed window by window: the result is the same."""
    kernels = {f: getattr(suffix_dedup, f) for f in ("_map_side", "_contents", "_meet", "_compare")}

    def inside(make):
        """The worker's own module gets the value too."""

        def made(*args):
            def run(batches):
                setattr(suffix_dedup, name, value)
                return make(*args)(batches)

            return run

        return made

    for f, make in kernels.items():
        monkeypatch.setattr(suffix_dedup, f, inside(make))
    monkeypatch.setattr(suffix_dedup, name, value)
    rows = repeated_rows(random.Random(10))
    got = suffix_dedup.remove_repeats(docs_of(spark, rows, True).repartition(5), keep=["doc_id"]).collect()
    want = brute.repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        n, removed, spans, kept = want[r["doc_id"]]
        assert bytes(r["_kept"]) == kept and len(r["_spans"]) == spans and sum(s["end"] - s["start"] for s in r["_spans"]) == removed


def test_windows_are_compared_by_previous_factors(monkeypatch):
    """The kernel that compares different segments asks the longest-previous-factor array and nothing else."""
    asked, own = [], suffix_dedup.longest_previous_factors
    monkeypatch.setattr(suffix_dedup, "longest_previous_factors", lambda order, lcp: asked.append(len(order)) or own(order, lcp))
    texts = [b"xabcdefgh", b"yabcdefgz"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([7, 7]), pa.array([1, 2]), pa.array([0, 0]), pa.array([0, 0], pa.int32()), pa.array(texts)], ["bucket", "h", "doc", "t", "start", "bytes"])
    out = [r for b in suffix_dedup._compare(5)(iter([batch])) for r in b.to_pylist()]
    assert asked == [10] and [(r["doc"], r["start"], r["end"]) for r in out] == [(2, 1, 8)]


def test_passage_in_every_document(spark):
    """Edges of a passage that all documents have, each among other text, are crowded anchors."""
    rng = random.Random(21)
    passage = words(rng, 30)
    rows = [(i, f"{words(rng, 12)} {passage} {words(rng, 12)}") for i in range(300)]
    own = docs_of(spark, rows)
    assert len(suffix_dedup._crowded(own.select(F.col("doc_id").alias("_doc"), F.lit(0).cast("long").alias("_t"), F.col("text").alias("_text")), 100, 32))
    want = brute.repeats(rows)
    for r in suffix_dedup.remove_repeats(own).collect():
        assert bytes(r["_kept"]) == want[r["doc_id"]][3]


def test_shared_keys_are_documents_of_their_own(spark):
    rng = random.Random(22)
    passage = words(rng, 40)
    rows = [(None if i % 2 else 5, f"{words(rng, 10)} {passage}") for i in range(10)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows, True).withColumns({"_kept": F.lit(1), "_spans": F.lit(2)})).collect()
    assert len(got) == 10 and sum(len(r["_spans"]) == 0 for r in got) == 1
    cut = suffix_dedup.without_repeats(docs_of(spark, rows, True).withColumns({"_kept": F.lit(1), "_spans": F.lit(2)}))
    assert {(r["_kept"], r["_spans"], r["_doc"]) for r in cut.collect()} == {(1, 2, "x")}
    assert sorted(r["text"] for r in cut.collect()) == sorted(bytes(r["_kept"]).decode() for r in got)


def test_remove_repeats_leaves_whole_characters(spark):
    rows = [(1, "é" * 60), (2, "a" + "é" * 60 + "z")]
    got = {r["doc_id"]: bytes(r["_kept"]) for r in suffix_dedup.remove_repeats(docs_of(spark, rows), whole_chars=True).collect()}
    want = {d: x[3].decode("utf-8", "ignore").encode() for d, x in brute.repeats(rows).items()}
    assert got == want and got[2].decode().strip("é") == "az"


def test_remove_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).collect() == []
    twice = suffix_dedup.remove_repeats(docs_of(spark, [(1, "q" + words(random.Random(1), 60))] * 2 + [(None, "w" * 150)])).collect()
    assert sorted(len(r["_spans"]) for r in twice) == [0, 0, 1]


# URL rules


def test_url_rules(spark):
    urls = ["http://A.example.NET/en/1?x#y", "https://example.net/de/", "http://net/", "http://net", "http://notnet/", "http://x.example.com/de/#a", "http://x.org/fr/", "http://org/fr", "ftp://u://b.net/q", "nothing", "", None, "http://example.net/en/?z", "://net/x", "http://h.net?q/", "http://a.net/\nx"]
    pages = spark.createDataFrame([(i % 15, u) for i, u in enumerate(urls * 2)], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("suffix", F.lit(1))
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    plain = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    out = url_filter.judge(pages, rules).collect()
    assert len(out) == len(urls) * 2
    for r in out:
        url = r["url"] or ""
        host, path = "", ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].translate(brute.UPPER), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [x for x in plain if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["_host"], r["_path"], r["_rule"], r["_verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), url
    assert {r["_verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_host_of_many_labels(spark):
    """Only suffixes as long as some rule's are made, so a host of 20,000 labels is no more work than another."""
    pages = spark.createDataFrame([(1, f"http://{'a.' * 20_000}example.net/en/x"), (2, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, verdict string")
    got = url_filter.judge(pages, rules)
    assert [r["_rule"] for r in got.orderBy("page_id").collect()] == ["example.net/en/", "net/"]
    assert got.select(F.size(url_filter.host_suffixes(F.col("_host"), [1, 2])).alias("n")).agg(F.max("n")).first()[0] == 2


# decontamination


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_decontaminate(spark, block):
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([0, 1, 4, 9, 10, 11, 40]), 30)) for i in range(40)] + [(50, None), (None, words(rng, 15)), (51, "A, b. C")]
    items += [(60, items[7][1])]
    docs = [(i, " ".join(rng.choice([words(rng, 12, 30), (rng.choice(items)[1] or "").upper()]) for _ in range(5))) for i in range(60)] + [(1000 + i, t) for i, t in AWKWARD if i >= 0]
    got = decontaminate.decontaminate(docs_of(spark, docs, True), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    want = brute.windows_hit(docs, items)
    for r in got:
        n, hit, names = want[r["doc_id"]] if r["doc_id"] in want else None
        assert (r["_n_words"], sum(s["end"] - s["start"] for s in r["_hit_spans"]), r["_item_ids"]) == (n, hit, names), r["doc_id"]
    assert len(got) == len(docs)


def test_decontaminate_edges(spark):
    items = spark.createDataFrame([(1, words(random.Random(1), 20))], "item_id long, text string")
    assert decontaminate.clean(docs_of(spark, []), items).collect() == []
    assert decontaminate.clean(docs_of(spark, AWKWARD, True), items.limit(0)).count() == len(AWKWARD)
    kept = decontaminate.clean(docs_of(spark, [(1, "x " + items.first()["text"]), (2, "fine")]), items)
    assert [tuple(r) for r in kept.collect()] == [(2, "fine")]


# SimHash


def near_rows(rng):
    base = [words(rng, 80, 5000) for _ in range(12)]
    rows = []
    for i in range(60):
        w = base[i % 12].split()
        for _ in range(i // 24):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i * 3, " ".join(w)))
    return rows + [(1000 + i, t) for i, t in AWKWARD if i >= 0]


def test_simhash_groups(spark):
    rows = near_rows(random.Random(12))
    got = {r["doc_id"]: r for r in simhash.group(simhash.fingerprints(docs_of(spark, rows, True))).collect()}
    prints = {d: brute.simhash(t) for d, t in rows}
    assert {d: r["fp"] % 2**64 for d, r in got.items()} == prints
    want = brute.groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert simhash.group(simhash.fingerprints(docs_of(spark, []))).collect() == []


@pytest.mark.parametrize("bits, segments", [(4, 3), (3, 3), (2, 4), (5, 2), (4, 4)])
def test_near_pairs_are_all_found(spark, bits, segments):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(15)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(8)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, segments).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= bits}


def test_forest_is_the_shortest():
    rng = np.random.default_rng(4)
    for _ in range(50):
        m = int(rng.integers(1, 120))
        a, b, length = rng.integers(0, 25, m), rng.integers(25, 50, m), rng.integers(0, 9, m)
        parent = list(range(50))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        best = 0
        for i in np.argsort(length, kind="stable"):
            x, y = find(a[i]), find(b[i])
            if x != y:
                parent[x], best = y, best + length[i]
        got = simhash.forest(a, b, length)
        assert length[got].sum() == best and got.sum() == 50 - len({find(x) for x in range(50)})


def test_candidates_grow_with_the_nodes():
    """In one bucket of alike fingerprints a forest is given, not all pairs, also where a run is longer than a chunk."""
    rng = np.random.default_rng(5)
    for n in (40, 500):
        lanes = np.zeros((n, simhash.LANES), np.int64)
        lanes[:, -1] = rng.integers(0, 1 << 8, n)
        rows = np.column_stack([np.arange(n), np.arange(n), np.full(n, 100), lanes])
        packed = rows.astype("<i8").tobytes() + np.arange(n, dtype="<i4").tobytes() + np.full(n, 9, "<i8").tobytes()
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([n]), pa.array([packed])], ["bucket", "n", "packed"])
        for forests in (1, 3):
            found = {(r["a"], r["b"]) for b in simhash._candidates(70, 0.8, forests)(iter([batch])) for r in b.to_pylist()}
            assert n - 1 <= len(found) <= forests * (n - 1)
            assert n > 100 or set(brute.groups(list(range(n)), lambda a, b: (a, b) in found).values()) == {0}  # noqa: B023


def test_more_fingerprints_take_wider_segments(spark, monkeypatch):
    rows = near_rows(random.Random(12))
    few = {r["doc_id"]: r["component_id"] for r in simhash.group(simhash.fingerprints(docs_of(spark, rows))).collect()}
    monkeypatch.setattr(simhash, "SEGMENTS", ((1, 3), (1 << 62, 2)))
    assert few == {r["doc_id"]: r["component_id"] for r in simhash.group(simhash.fingerprints(docs_of(spark, rows))).collect()}


def test_near_groups_find_copies_and_leave_others(spark):
    rng = random.Random(14)
    rows, kin = [], {}
    for i in range(40):
        text = words(rng, 200, 3000)
        rows.append((i, text))
        w = text.split()
        for e in range(3):
            w[rng.randrange(200)] = "edit"
            rows.append((100 + 3 * i + e, " ".join(w)))
            kin[100 + 3 * i + e] = i
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, "unlike all others here")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs_of(spark, rows, True)).collect()}
    assert sum(got[d] == i for d, i in kin.items()) >= 0.97 * len(kin)
    assert all(got[i] == i for i in range(40)) and got[901] == got[900] == 900 and got[902] == 0 and got[903] == 903
    kept = simhash.drop_near_duplicates(docs_of(spark, rows + [(0, rows[0][1]), (903, "unlike all others here")], True))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids)) and set(range(40)) | {900, 903} <= set(ids) and len(ids) <= 42 + 4
    assert simhash.drop_near_duplicates(docs_of(spark, [])).collect() == []


def test_shared_and_null_keys_keep_unlike_texts(spark):
    rng = random.Random(15)
    texts = [words(rng, 60, 5000) for _ in range(30)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (7, texts[1]), (7, texts[2]), (8, texts[3]), (None, None), (None, ""), (9, None)]
    kept = [(r["doc_id"], r["text"] or "") for r in simhash.drop_near_duplicates(docs_of(spark, rows, True)).collect()]
    assert sorted(t for _, t in kept) == sorted([*texts, ""])
    assert {t: d for d, t in kept} == {t: None if i % 2 or i == 0 else 7 for i, t in enumerate(texts)} | {"": None}
    got = simhash.near_groups(docs_of(spark, [(5, texts[4]), (5, texts[5]), (6, texts[5])])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["rows"]) for r in got) == [(5, 5, 1), (5, 5, 1), (6, 5, 1)]


def exact_groups(rows):
    """(smallest linked id of each, similarity of two ids) by all pairs of whole shingle sets."""
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return brute.groups(sorted(sets), lambda a, b: like(a, b) >= 0.8), like


def template_rows(rng):
    """Families of texts that share a template: similarities of 0.5 to 0.8 without copies, and one with close copies."""
    rows = []
    for family in range(4):
        base = words(rng, 150, 5000).split()
        for i in range(60):
            w = list(base)
            for at in rng.sample(range(150), (6, 5, 4, 1 + i % 5)[family]):
                w[at] = f"own{family}x{i}x{at}"
            rows.append((100 * family + i, " ".join(w)))
    return rows


def test_near_groups_hold_the_similarity(spark):
    rows = template_rows(random.Random(16))
    want, like = exact_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs_of(spark, rows, True)).collect()}
    assert set(got) == set(want)
    assert all(want[d] == want[g] for d, g in got.items()), "a group holds what no links of 0.8 reach"
    assert sum(got[d] != want[d] for d in want) <= 2


def test_pairs_just_above_the_similarity_are_found(spark):
    """Groups of two at 0.81, which no other link of a group makes up for."""
    rng, rows = random.Random(19), []
    for i in range(400):
        w = [f"p{i}w{k}x{rng.randrange(10**6)}" for k in range(100)]
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(10, 45)] = w[rng.randrange(55, 90)] = "edit"
        rows.append((2 * i + 1, " ".join(w)))
        one, two = (brute.shingles(t, 5) for _, t in rows[-2:])
        assert 0.8 <= len(one & two) / len(one | two) < 0.82
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs_of(spark, rows)).collect()}
    assert all(got[d] == d for d in got if d % 2 == 0) and sum(got[d] == d - 1 for d in got if d % 2) >= 0.98 * 400


def test_many_refused_candidates_hide_no_link(spark):
    """Equal fingerprints in one run: 70 texts of which only the farthest two in order are alike, and two groups between
    which the likely candidates are refused: no count of forests or length of a run decides what is compared."""
    rng = random.Random(23)
    base = words(rng, 150, 5000).split()
    rows = [(i, " ".join(f"x{i}y{j}" if j % 8 == i % 8 else w for j, w in enumerate(base))) for i in range(80)]
    rows[79] = (79, rows[0][1] + " end")
    # Distances put every other text between the two: the pair is the longest of the run.
    lanes = [[(1 << i % 40) - 1 if i else 0, *[0] * (simhash.LANES - 1)] for i in range(80)]
    lanes[79] = [(1 << 45) - 1, *[0] * (simhash.LANES - 1)]
    nodes = [(i, i, len(brute.shingles(t, 5)), v, bytes(range(3)) * (simhash.KEY_LANES * simhash.LANE_SEGMENTS), (d, d)) for i, ((d, t), v) in enumerate(zip(rows, lanes, strict=True))]
    schema = "node long, label long, size long, lanes array<long>, free binary, first struct<id:long,t:long>"
    texts = spark.createDataFrame([(d, d, t) for d, t in rows], "id long, t long, text string")
    links = simhash._links(common.materialize(spark.createDataFrame(nodes, schema).drop("label"), "nodes"), texts, 5, 0.8).collect()
    assert {(r["a"], r["b"]) for r in links} == {(0, 79)}


def test_refused_candidates_hide_no_links(spark):
    """A run of equal probes: the smallest node is near all in distance but similar to none, the others are in two chains."""
    rng = random.Random(17)
    base = words(rng, 150, 5000).split()

    def variant(name, places):
        return " ".join(f"{name}{i}" if i in places else w for i, w in enumerate(base))

    rows = [(0, variant("z", range(20, 150, 26)))]
    for chain in range(2):
        rows += [(1 + 10 * chain + i, variant(f"c{chain}x", {40 * chain + 15 + 30 * k for k in range(3)} | {140 + i % 2})) for i in range(2)]
    nodes = [(i, i, len(brute.shingles(t, 5)), [0] * simhash.LANES, bytes(range(3)) * (simhash.KEY_LANES * simhash.LANE_SEGMENTS), (d, d)) for i, (d, t) in enumerate(rows)]
    nodes += [(100 + i, 100 + i, 146, [0] * simhash.LANES, bytes(range(3)) * (simhash.KEY_LANES * simhash.LANE_SEGMENTS), (100 + i, 100 + i)) for i in range(12)]
    rows += [(100 + i, variant(f"s{i}x", range(10 + i, 150, 9))) for i in range(12)]
    schema = "node long, label long, size long, lanes array<long>, free binary, first struct<id:long,t:long>"
    texts = spark.createDataFrame([(d, d, t) for d, t in rows], "id long, t long, text string")
    links = simhash._links(common.materialize(spark.createDataFrame(nodes, schema).drop("label"), "nodes"), texts, 5, 0.8).collect()
    number = {n[0]: n[5][0] for n in nodes}
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    found = {frozenset((number[r["a"]], number[r["b"]])) for r in links}
    assert all(like(*p) >= 0.8 for p in found)
    assert brute.groups(sorted(sets), lambda a, b: frozenset((a, b)) in found) == exact_groups(rows)[0]
    assert len(set(exact_groups(rows)[0].values())) < len(rows)


def test_materialize_keeps_rows(spark):
    assert common.materialize(docs_of(spark, AWKWARD), "x").count() == len(AWKWARD)


def test_prefix_pairs_lose_none_that_is_similar(spark):
    """Against all pairs of sets: edited copies of a few texts, sizes of all kinds, a similarity met exactly."""
    rng = random.Random(41)
    rows = []
    for family in range(6):
        base = [rng.getrandbits(62) for _ in range(10 + 30 * family)]
        for i in range(20):
            own = set(base[: len(base) - rng.randrange(3)]) - set(rng.sample(base, rng.randrange(1 + len(base) // 6)))
            rows.append((len(rows), i % 7, sorted(own | {rng.getrandbits(62) for _ in range(rng.randrange(1 + len(base) // 8))})))
    rows += [(len(rows), 900, [1, 2, 3, 4]), (len(rows) + 1, 901, [1, 2, 3, 4, 5]), (len(rows) + 2, 902, []), (len(rows) + 3, 903, [6])]
    sets = spark.createDataFrame([(n, g) for n, _, g in rows], "node long, grams array<long>")
    nodes = spark.createDataFrame([(n, label) for n, label, _ in rows], "node long, label long")
    got = {(r["a"], r["b"]) for r in simhash._prefix_pairs(nodes, sets, 0.8).collect()}
    want = {(a, b) for a, x, g in rows for b, y, h in rows if a < b and x != y and g and len(set(g) & set(h)) / len(set(g) | set(h)) >= 0.8}
    assert len(want) > 100 and want <= got
    assert all(rows[a][1] != rows[b][1] for a, b in got)


def test_last_round_compares_few_of_copies_that_stay_apart(spark, monkeypatch):
    """Copies of one text, each with so many edits of its own that none is alike another: their fingerprints are near, yet
    few of their pairs are compared; two alike ones among them are found."""
    rng = random.Random(43)
    base = words(rng, 150, 5000).split()
    rows = [(i, " ".join(f"x{i}y{j}" if j in set(rng.sample(range(150), 5)) | {7 + i % 3, 75, 140} else w for j, w in enumerate(base))) for i in range(120)]
    rows[119] = (119, rows[3][1] + " end")
    nodes = [(i, len(brute.shingles(t, 5)), [0] * simhash.LANES, bytes(range(3)) * (simhash.KEY_LANES * simhash.LANE_SEGMENTS), (d, d)) for i, (d, t) in enumerate(rows)]
    schema = "node long, size long, lanes array<long>, free binary, first struct<id:long,t:long>"
    texts = spark.createDataFrame([(d, d, t) for d, t in rows], "id long, t long, text string")
    compared, confirmed = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, *more: compared.append(pairs.count()) or confirmed(pairs, *more))
    links = simhash._links(common.materialize(spark.createDataFrame(nodes, schema), "nodes"), texts, 5, 0.8).collect()
    want = {(a, b) for a, s in rows for b, t in rows if a < b and len(brute.shingles(s, 5) & brute.shingles(t, 5)) / len(brute.shingles(s, 5) | brute.shingles(t, 5)) >= 0.8}
    assert want == {(3, 119)} == {(r["a"], r["b"]) for r in links}
    assert compared[-1] <= len(rows)  # all pairs are 7140
