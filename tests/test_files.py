"""Blocked gzip and BAM: against the plain content, by splits, by region, with damage where nothing should be opened."""

import gzip
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.config import Config
from strandlake.operators import reads
from strandlake.plans.pipeline import Pipeline
from strandlake.plans import queries
from strandlake.sources import bam, bgzf, text

REFERENCES = {"chr5": 2_000_000, "chr6": 3_000_000, "chrX": 1000}


def blocked(path, data, payload=500):
    parts = [bgzf.member(data[a : a + payload]) for a in range(0, len(data), payload)]
    path.write_bytes(b"".join([*parts, bgzf.member(b"")]))
    return str(path)


def test_members_are_gzip(tmp_path):
    data = random.Random(1).randbytes(3000) + b"x" * 9000
    assert gzip.decompress(open(blocked(tmp_path / "a.gz", data), "rb").read()) == data
    assert bgzf.member(b"").hex() == "1f8b08040000000000ff0600424302001b0003000000000000000000"


@pytest.mark.parametrize("seed", range(6))
def test_lines_by_splits(tmp_path, seed):
    """Every line comes once and in order, wherever splits and blocks end; also with line breaks at their edges."""
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abc\x1f\x8b") for _ in range(rng.choice([0, 1, 5, 40, 900]))) for _ in range(200)]
    data = "\n".join(lines).encode() + b"\n" * rng.randrange(2)
    path = blocked(tmp_path / "a.gz", data, rng.choice([1, 7, 64, 500, 5000]))
    size = (tmp_path / "a.gz").stat().st_size
    want = [x for x in data.split(b"\n")]
    if want[-1] == b"":
        want.pop()
    for step in (size, size // 3 + 1, size // 17 + 1, 97):
        got = []
        for at in range(0, size, step):
            with bgzf.Blocks(path) as blocks:
                got += [x for some in bgzf.lines(blocks, at, at + step) for x in some]
        assert got == want


def test_damage_is_told(tmp_path):
    path = blocked(tmp_path / "a.gz", b"one\ntwo\n" * 400)
    raw = bytearray((tmp_path / "a.gz").read_bytes())
    raw[300] ^= 255
    (tmp_path / "a.gz").write_bytes(raw)
    with bgzf.Blocks(path) as blocks, pytest.raises((ValueError, zlib.error)):
        list(bgzf.lines(blocks, 0, 1 << 20))


def test_lines_in_spark(spark, tmp_path):
    """Blocked, plain gzip, several members without sizes and an empty file; four splits equal one."""
    body = "".join(f"chr6\t{i * 1000}\t{i * 1000 + 1000}\t{i % 7}.5\n" for i in range(3000))
    blocked(tmp_path / "S1.regions.bed.gz", body.encode())
    (tmp_path / "S2.regions.bed.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "S3.regions.bed.gz").write_bytes(gzip.compress(body[:999].encode()) + gzip.compress(body[999:].encode()))
    blocked(tmp_path / "S4.regions.bed.gz", b"")
    (tmp_path / "S5.txt").write_text("not one of them")
    size = (tmp_path / "S1.regions.bed.gz").stat().st_size
    some = bgzf.read_lines(spark, str(tmp_path), ".bed.gz", size // 4 + 1)
    assert some.rdd.getNumPartitions() > 4
    for n in ("S1", "S2", "S3"):
        own = [r["value"] for r in some.where(F.endswith("path", F.lit(f"{n}.regions.bed.gz"))).collect()]
        assert own == body.splitlines()
    depth = text.read_depth(spark, str(tmp_path), split_bytes=size // 4 + 1)
    assert {(r["sample_id"], r["n"], r["d"]) for r in depth.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("depth").alias("d")).collect()} == {(n, 3000, sum(i % 7 + 0.5 for i in range(3000))) for n in ("S1", "S2", "S3")}
    assert depth.orderBy("sample_id", "start").first().asDict() == {"sample_id": "S1", "chrom": "chr6", "start": 0, "end": 1000, "depth": 0.5}


def test_lines_are_written_in_order_by_several_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "b.gz").otherwise("a.gz").alias("name"), F.concat(F.lit("line "), "id").alias("value"), (-F.col("id")).alias("o"))
    bgzf.write_lines(rows.repartition(7), f"file://{tmp_path}/out", ["o"], 6)
    got = {p.name: gzip.decompress(p.read_bytes()).decode().splitlines() for p in (tmp_path / "out").iterdir()}
    assert got == {n: [f"line {i}" for i in range(4999, -1, -1) if (i % 5 == 0) == (n == "b.gz")] for n in ("a.gz", "b.gz")}


def test_bins():
    rng = np.random.default_rng(3)
    begin = rng.integers(0, 1 << 29, 300)
    end = np.minimum(begin + (1 << rng.integers(1, 25, 300)), 1 << 29)
    for b, e, n in zip(begin.tolist(), end.tolist(), bam.smallest_bin(begin, end).tolist(), strict=True):
        own = bam.touched_bins(b, e)
        assert n in own
        size = {0: 29, **{i: 29 - 3 * k for k in range(1, 6) for i in range((8**k - 1) // 7, (8 ** (k + 1) - 1) // 7)}}
        assert not [m for m in own if size[m] < size[n] and {m} == {x for x in own if size[x] == size[m]}]


def alignments_of(spark, n, seed=1, cigar=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chrom = rng.choice(["chr5", "chr6", "chr6"])
        pos = rng.randrange(1_900_000)
        ops = rng.choice(["100M", "5S40M3I10D50M10N7M2S", "20H1000=5X", "60M20000N40M", "10I", "*"])
        cover = sum(int(k) for k, o in __import__("re").findall(r"(\d+)(.)", ops) if o in "MDN=X")
        rows.append((f"S{i % 3}", chrom, pos, rng.choice([83, 99, 1107]), rng.randrange(60), rng.choice([chrom, "chrX", None]), pos + max(1, cover), ops))
    rows += [("S0", None, -1, 77, 0, None, 0, "*"), ("S1", "chr6", 2_999_999, 83, 9, "chr6", 3_000_000, "1M")]
    df = spark.createDataFrame(rows, bam.SCHEMA)
    return df if cigar else df.drop("cigar")


def told(df):
    return sorted(tuple(repr(v) for v in r) for r in df.collect())


def test_bam_round_trip(spark, tmp_path):
    own = alignments_of(spark, 4000)
    bam.write_bam(own, f"file://{tmp_path}/b", REFERENCES, 5)
    names = sorted(p.name for p in (tmp_path / "b").iterdir())
    assert all(n.endswith((".bam", ".bai")) for n in names) and {n.split(".")[0] for n in names} == {"S0", "S1", "S2"} and len(names) > 6
    back = bam.read_bam(spark, f"file://{tmp_path}/b")
    want = own.withColumn("end", F.when(F.col("chrom").isNull(), F.lit(0)).otherwise(F.col("end")))
    assert told(back) == told(want)
    for step in (997, 5000, 40000):
        assert told(bam.read_bam(spark, str(tmp_path / "b"), split_bytes=step)) == told(want)
    for p in (tmp_path / "b").glob("*.bai"):
        p.unlink()
    assert told(bam.read_bam(spark, str(tmp_path / "b"), split_bytes=997)) == told(want)
    region = ("chr6", 100000, 120000)
    assert told(bam.read_bam(spark, str(tmp_path / "b"), region)) == told(reads.region_slice(own, *region))


@pytest.mark.parametrize("region", [("chr6", 0, 1), ("chr6", 100_000, 140_000), ("chr5", 1_899_000, 2_000_000), ("chr6", 0, 3_000_000), ("chr6", 2_999_999, 3_000_000), ("chr6", 2_500_000, 2_600_000), ("chr6", 5, 5), ("chrX", 0, 1000), ("chr1", 0, 10)])
def test_bam_region(spark, tmp_path, region):
    """A region gives what overlaps it, also reads that begin long before it by a skip; splits give each read once."""
    own = alignments_of(spark, 3000, 2)
    bam.write_bam(own, str(tmp_path), REFERENCES, 2)
    want = told(reads.region_slice(own, *region)) if region[1] < region[2] else []
    assert told(bam.read_bam(spark, str(tmp_path), region)) == told(bam.read_bam(spark, str(tmp_path), region, 3000)) == want


def test_bam_opens_only_chunks_of_the_region(spark, tmp_path, monkeypatch):
    """Blocks outside the region's chunks are damaged: a read of the whole fails, one of the region does not. And few bytes
    are fetched."""
    own = spark.range(200000).select(F.lit("S1").alias("sample_id"), F.lit("chr6").alias("chrom"), (F.col("id") * 15).alias("pos"), F.lit(83).alias("flag"), (F.hash("id") % 30 + 30).alias("mapq"), F.lit("chr6").alias("next_chrom"), (F.col("id") * 15 + 90).alias("end"))
    bam.write_bam(own, str(tmp_path), REFERENCES, 1)
    (path,) = tmp_path.glob("*.bam")
    monkeypatch.setattr(bgzf, "WINDOW", 1 << 12)
    index = bam.Index.read(f"{path}.bai")
    with bgzf.Blocks(str(path)) as blocks:
        got = pa.Table.from_batches(bam.read_part(blocks, index, "S1", region=("chr6", 1_500_000, 1_510_000)))
        assert got.num_rows == own.where("pos < 1510000 and end > 1500000").count()
        assert blocks.fetched < blocks.size / 8
    chunks = index.chunks(1, 1_500_000, 1_510_000)
    raw, at, starts = bytearray(path.read_bytes()), 0, []
    while at < len(raw):
        starts.append(at)
        at += struct.unpack_from("<H", raw, at + 16)[0] + 1
    for at in starts[1:-1]:
        if not any(a >> 16 <= at <= b >> 16 for a, b in chunks):
            raw[at + 30] ^= 255
    path.write_bytes(raw)
    assert bam.read_bam(spark, str(tmp_path), ("chr6", 1_500_000, 1_510_000)).count() == got.num_rows
    with pytest.raises(Exception, match="damaged|Error"):
        bam.read_bam(spark, str(tmp_path)).count()


def test_bam_refuses(spark, tmp_path):
    with pytest.raises(Exception, match="chr9"):
        bam.write_bam(spark.createDataFrame([("S1", "chr9", 1, 83, 9, "chr9", 5)], "sample_id string, chrom string, pos long, flag int, mapq int, next_chrom string, end long"), str(tmp_path / "x"), REFERENCES, 1)
    (tmp_path / "S1.bam").write_bytes(bgzf.member(b"nothing of the kind") + bgzf.member(b""))
    with pytest.raises(Exception, match="no BAM file"):
        bam.read_bam(spark, str(tmp_path / "S1.bam")).count()
    with pytest.raises(Exception, match="FileNotFound"):
        bam.read_bam(spark, str(tmp_path / "none")).count()


def test_bam_of_nothing(spark, tmp_path):
    bam.write_bam(alignments_of(spark, 10).where("flag < 0"), str(tmp_path / "b"), REFERENCES, 2)
    assert bam.read_bam(spark, str(tmp_path / "b")).count() == 0


def test_counts_of_bam_files(spark, tmp_path):
    """A sound file without reads in the region counts 0, a damaged one is an error, one without a file has no row; a file
    that is named after a run belongs to the sample inside its name."""
    (tmp_path / "data").mkdir()
    own = alignments_of(spark, 600, 4)
    bam.write_bam(own.where("sample_id <> 'S2'").withColumn("sample_id", F.when(F.col("sample_id") == "S1", "run7_S1_x").otherwise(F.col("sample_id"))), str(tmp_path / "data"), REFERENCES, 1)
    bam.write_bam(own.where("sample_id = 'S2' and chrom = 'chr5'"), str(tmp_path / "data"), REFERENCES, 1)
    (tmp_path / "data" / "S4_v1.bam").write_bytes(bgzf.member(b"BAM\1 and then nothing sound"))
    (tmp_path / "s.txt").write_text("S0\nS1\nS2\nS3\nS4\n")
    values = {
        "samples_file": str(tmp_path / "s.txt"), "directory_loc": str(tmp_path / "data"), "output_dir": str(tmp_path / "out"), "file_type": "bam", "chrom": "chr6", "start_bp": 0, "end_bp": 900_000,
        "count_reads": {"run": True, "flags": [83, 99], "output_file_prefix": "counts"},
    }
    pipeline = Pipeline(Config(values))
    flags = pipeline.config.flags()
    done = {r["sample_id"]: r["reads"] for r in pipeline.count_reads(spark).collect()}
    want = {r["sample_id"]: r["reads"] for r in reads.count_reads(own, spark.createDataFrame([("S0",), ("S1",)], "sample_id string"), "chr6", 0, 900_000, flags).collect()}
    assert flags and min(want.values()) > 5 and done == {**want, "S2": 0}
    assert "S4\tError" in [x for p in (tmp_path / "out" / "counts").glob("part-*") for x in p.read_text().splitlines()]


def test_tasks_grow_with_bytes_not_with_files(spark, tmp_path):
    """Many small files are few tasks, each line and read once; nothing of the tasks' own folders stays."""
    rows = spark.range(900).select(F.format_string("S%03d.bed.gz", F.col("id") % 300).alias("name"), F.concat(F.lit("chr6\t1\t2\t"), "id").alias("value"), "id")
    bgzf.write_lines(rows, str(tmp_path / "l"), ["id"])
    lines = bgzf.read_lines(spark, str(tmp_path / "l"), ".bed.gz", 1 << 12)
    assert lines.rdd.getNumPartitions() <= 40 and lines.select("value").distinct().count() == lines.count() == 900
    assert bgzf.paths(spark, str(tmp_path / "l"), ".bed.gz").exceptAll(lines.select("path").distinct()).count() == 0
    own = alignments_of(spark, 600).withColumn("sample_id", F.concat(F.lit("S"), F.col("pos") % 200)).where("chrom is not null")
    bam.write_bam(own, str(tmp_path / "b"), REFERENCES)
    back = bam.read_bam(spark, str(tmp_path / "b"), split_bytes=1 << 12)
    assert back.rdd.getNumPartitions() <= 40 and told(back) == told(own)
    assert all(p.is_file() for n in "lb" for p in (tmp_path / n).iterdir())


def test_lines_with_a_head_are_written_by_several_tasks(spark):
    """The head stands first in the order of files, and no task has all lines."""
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("S"), "id").alias("s"))
    path = queries._text(rows, F.concat_ws("\t", "s", F.lit("1\t0\t1.5\t0.1\tS2\t2")), "ID\thap\tnbrInd\tcMlen\tcMedge\tIDnbr\thapNbr")
    assert spark.read.text(path).select(F.input_file_name()).distinct().count() == 5
    assert text.read_ibs(spark, path).count() == 4000
