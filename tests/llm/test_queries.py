"""The registered queries on the smallest tables, against SQL where there is some, and against brute force."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import bpe, queries, toxicity
from tests.llm import brute
from tests.test_entry import SF, same


def table(name):
    return duckdb.connect().execute(f"select * from '{SF}/{name}.parquet'").fetchall()


DOCS = [r[:2] for r in table("documents")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(spark, name, queries.queries()[name], queries.oracle_sql()[name])


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


def test_op2(spark):
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = rows(spark, "op2_byte_bpe")
    for d, t in DOCS:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), brute.sha(ids.tobytes()), brute.sha(t or ""))


def test_op4(spark):
    got = rows(spark, "op4_fingerprints")
    order, seen = sorted(DOCS, reverse=True), {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == (len(t), brute.sha(edited), float(brute.canonical(t) == brute.canonical(edited)), float(brute.canonical(t) == brute.canonical(nxt)))
        for text, f in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert seen.setdefault(brute.canonical(text), f) == f
    assert len(set(seen.values())) == len(seen)


def test_op5(spark):
    got = {r["doc_id"] for r in queries.op5_importance(spark, SF).collect()}
    good = {r[0] for r in table("labels") if r[1] == 1}
    assert len(got & good) > 0.95 * len(good)


def test_op6(spark):
    got = rows(spark, "op6_toxicity")
    assert set(got) == {d for d, _ in DOCS}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_op6_on_rows_it_did_not_learn_from(spark):
    """Of held-out labelled rows most toxic ones reach the threshold and hardly a clean one does."""
    sf = SF.replace("0.001", "0.1")
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = duckdb.connect().execute(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    held = [(got[d]["predicted"], toxic) for d, toxic in labels if d in got and got[d]["held_out"] and toxic is not None]
    caught, wrong = [p for p, t in held if t], [p for p, t in held if not t]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert len(caught) > 100 and sum(caught) >= 0.8 * len(caught) and sum(wrong) <= 0.01 * len(wrong)


def test_op7(spark):
    for d, (n, removed, spans, kept) in brute.repeats(DOCS).items():
        r = rows_op7(spark)[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, brute.sha(kept))


_kept = {}


def rows_op7(spark):
    if not _kept:
        _kept.update(rows(spark, "op7_suffix_dedup"))
    return _kept


def test_op10(spark):
    got, prints = rows(spark, "op10_simhash"), {d: brute.simhash(t) for d, t in DOCS}
    want = brute.groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_pipeline_stages(spark):
    """Each stage against what it must do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_shared", F.lit(1))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    inputs = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
        inputs.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.count() == len(inputs[-1])
    _, clean, single, cut, apart = inputs
    assert set(clean) < set(before) and set(single) < set(clean)
    shingles = {d: brute.shingles(t, 5) for d, t in clean.items()}
    likeness = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for d in set(clean) - set(single):
        assert any(likeness(d, e) > 0.6 for e in clean if e != d)
    assert not [1 for a in single for b in single if a < b and likeness(a, b) >= 0.92]
    want = brute.repeats(list(single.items()))
    assert cut == {d: re.sub("\ufffd", "", w[3].decode(errors="ignore")) for d, w in want.items()}
    hits = brute.windows_hit(list(cut.items()), table("benchmark"))
    assert set(apart) == {d for d, h in hits.items() if not h[1]} and all(apart[d] == cut[d] for d in apart)
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(coded) == len(apart) and all(r["round_trip"] for r in coded)


def test_near_dedup_against_exact_sets(spark):
    """The stage drops what components of exact similarity 0.8 drop: nothing else goes, at most one that should go stays."""
    sets = {d: brute.shingles(t, 5) for d, t in DOCS}
    want = brute.groups(sorted(sets), lambda a, b: len(shared := sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(shared)))
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    gone, right = set(sets) - kept, {d for d in sets if want[d] != d}
    assert right and len(gone - right) == 0 and len(right - gone) <= 1


def test_rejection_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, machine, keep=["doc_id"]).where(F.col("_score") >= toxicity.THRESHOLD).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert bad and kept == {d for d, _ in DOCS} - bad
