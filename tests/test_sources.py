"""Text formats there and back, the configuration, the whole run over files, and arrivals."""

import gzip
import os

import pytest
import yaml

from strandlake.__main__ import main
from strandlake.config import Config
from strandlake.operators import reads
from strandlake.plans.pipeline import Pipeline
from strandlake.sources import sinks, text
from strandlake.streaming import arrivals


def write(path, content):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(content)
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_readers(spark, tmp_path):
    assert rows(text.read_samples(spark, write(tmp_path / "s.txt", "S1\n\n S2 \n")).select("sample_id")) == [("S1",), ("S2",)]
    assert rows(text.read_mask(spark, write(tmp_path / "m.bed", "#c\nchr6\t1000\t3000\n6 0 1000\nchr6\t5\nchr6\tx\t5\n"))) == [("6", 0, 1000), ("chr6", 1000, 3000)]
    near = write(tmp_path / "n.tsv.gz", "S1\t30.5\tS2\t28.0\t0.05\tS3\t31.0\t0.08\nS2\t1\tS1\tx\t0.1\tS3\t2\nbad\n")
    assert rows(text.read_neighbors(spark, near)) == [("S1", 30.5, 1, "S2", 28.0, 0.05), ("S1", 30.5, 2, "S3", 31.0, 0.08), ("S2", 1.0, 2, "S3", 2.0, None)]
    assert len(rows(text.read_neighbors(spark, near, whole_triplets=True))) == 2
    assert rows(text.read_counts(spark, write(tmp_path / "r.tsv", "Sample\tchr6:1-2\nS1\t100\nS2\tError\nS1\t7\n"))) == [("S1", 7.0)]
    assert rows(text.read_exon_counts(spark, write(tmp_path / "e.tsv", "NWD123.cram\t10\t5\t3\t7\nbadline\nX\t1\t2\t3\tz\n"))) == [("NWD123", 10, 5, 3, 7)]
    assert rows(text.read_dipcn(spark, write(tmp_path / "d.txt", "ID dipCN\n1001 2.5\n\n1002 nan\n1003 3\n"))) == [("1001", 0, 2.5), ("1003", 1, 3.0)]
    assert rows(text.read_ibs(spark, write(tmp_path / "i.txt", "h\n1001\t1\t0\t1.5\t0.1\t1002\t2\n1001 0 0 1 1 1002 2\n")).drop("line_no")) == [("1001", 1, "1002", 2)]
    assert rows(text.read_ibd(spark, write(tmp_path / "ibd.txt", "A A_0 B B_1 6 100 200 x y 3.2 0.95\nshort\n")).drop("line_no")) == [("A", "A_0", "B", "B_1", 100, 200, 3.2, 0.95)]
    assert rows(text.read_genetic_map(spark, write(tmp_path / "g.txt.gz", "position Genetic_Map(cM)\n1 10\n3 30\n"))) == [(1, 10.0), (3, 30.0)]
    panel = write(tmp_path / "p.txt", "sample pop\nS1 GBR x\n")
    assert rows(text.read_panel(spark, panel)) == [("S1", "GBR")]
    whole = text.read_map(spark, write(tmp_path / "m.map", "6\trs1\t0\t10\nchr6\trs2\t0\t20\n7\trs3\t0\t5\nbad\n"))
    assert [r[1] for r in rows(text.map_of_chromosome(whole, "chr6"))] == ["rs1", "rs2"]
    sam = write(tmp_path / "a.sam", "@HD\nq\t83\tchr6\t101\t60\t10M\t=\t5\nbad\n")
    assert rows(text.read_sam(spark, sam, "S")) == [("S", "chr6", 100, 83, 60, "chr6", 110)]


def test_depth_goes_to_the_longest_known_sample(spark, tmp_path):
    for name in ("S_1_v.regions.bed.gz", "S_10.regions.bed.gz", "Z.regions.bed.gz"):
        write(tmp_path / name, "chr6\t0\t1000\t30.0\nbad\nchr6\t1\t2\tx\n")
    samples = spark.createDataFrame([("S_1",), ("S_10",), ("S",)], "sample_id string")
    assert rows(text.read_depth(spark, str(tmp_path / "*.bed.gz"), samples).select("sample_id", "depth")) == [("S_1", 30.0), ("S_10", 30.0)]


def test_normalized_matrix_there_and_back(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1, 1.0, 0.5), (1, 2, 2.0, 0.25)], "start long, end long, mu double, ratio double")
    scales = spark.createDataFrame([("A", 30.0), ("B", 20.5)], "sample_id string, scale double")
    z = spark.createDataFrame([("A", 0, 1, 0.125), ("A", 1, 2, -1.0), ("B", 1, 2, 2.0)], "sample_id string, start long, end long, z double")
    sinks.write_normalized(stats, scales, z, str(tmp_path / "n"))
    part = next(str(p) for p in (tmp_path / "n").glob("part-*"))
    assert gzip.open(part, "rt").read().splitlines() == ["2\t2\t1.000\t2.000", "2\t2\t0.500\t0.250", "A\t30.00\t0.12\t-1.00", "B\t20.50\tNA\t2.00"]
    ratios, back, cells = text.read_normalized(spark, part)
    assert rows(ratios) == [(0, 0.5), (1, 0.25)] and rows(back) == [("A", 30.0), ("B", 20.5)]
    assert rows(cells) == [("A", 0, 0.12), ("A", 1, -1.0), ("B", 1, 2.0)]


def test_exon_writer_and_csv(spark, tmp_path):
    sinks.write_exon_dipcn(spark.createDataFrame([("B", 2.123456789), ("A", 1.0)], "sample_id string, dip_cn double"), str(tmp_path / "e"))
    assert next((tmp_path / "e").glob("part-*")).read_text() == "ID\tdipCN\nA\t1.000000\nB\t2.123457\n"
    sinks.write_counts(spark.createDataFrame([("A", 5), ("B", None)], "sample_id string, reads long").coalesce(1), str(tmp_path / "c"), "chr6", 1, 2, "csv")
    assert next((tmp_path / "c").glob("part-*")).read_text() == "Sample,chr6:1-2\nA,5\nB,Error\n"


def good(tmp_path):
    for name in ("s.txt", "ref.fa"):
        write(tmp_path / name, "S1\n")
    return {"samples_file": str(tmp_path / "s.txt"), "directory_loc": "d", "reference_genome": str(tmp_path / "ref.fa"), "output_dir": str(tmp_path / "out"), "threads": 2, "file_type": "cram", "chrom": "chr6", "start_bp": 1, "end_bp": 2, "output_file_type": "tsv"}


def test_config(tmp_path):
    base = good(tmp_path)
    assert Config(base).validate().errors == []
    assert Config({k: v for k, v in base.items() if k != "chrom"}).validate().errors
    assert Config({**base, "threads": "2"}).validate().errors
    assert Config({**base, "samples_file": "/none"}).validate().errors
    assert Config({**base, "count_reads": {"run": False}}).validate().errors == []
    assert Config({**base, "count_reads": {"run": True}}).validate().errors
    report = Config({**base, "neighbors": {"run": True}}).validate()
    assert report.errors == [] and len(report.warnings) == 5
    assert Config({"min_mapq": 7}).step("count_reads")["min_mapq"] == 7
    assert Config({"count_reads": {"flags": [83, None]}}).flags() == [83]
    assert main(["check", "/none.yaml"]) == 1
    path = write(tmp_path / "c.yaml", yaml.safe_dump(base))
    assert main(["check", path]) == 0


EXAMPLE = """
samples_file: "{0}/s.txt"
directory_loc: "{0}/data"
reference_genome: "{0}/ref.fa"
output_dir: "{0}/out"
threads: 4
file_type: "cram"
chrom: "chr6"
start_bp: 0
end_bp: 8000
output_file_type: "tsv"
index: {{run: False, output_file_prefix: "index_file_results"}}
count_reads: {{run: True, output_file_prefix: "read_counts", min_mapq: 1, flags: [83, 147]}}
mosdepth:
  run: True
  output_file_prefix: "mosdepth_results"
  bin_size: 1000
  mode: "fast"
  region_name: "LPA"
  work_dir: "{0}/depth/*.bed.gz"
  remove_intermediate: False
  normalize: {{run: True, min_depth: 20, max_depth: 100, top_frac: 0.1, output_file_prefix: "normalized", repeat_mask_file: "{0}/mask.bed"}}
  neighbors: {{run: True, output_file_prefix: "neighbor_coverage", num_neighbors: 3, zmax: 2.0, sigma2_max: 1000}}
compute_diploid_genotypes: {{run: True, output_file_prefix: "diploid_genotypes", n_nbr: 300}}
compute_haploid_genotypes: {{run: True, output_file_prefix: "haploid_genotypes", method: "ibs", min_neighbors: 1, max_neighbors: 10, n_iters: 4, ibs_output: "{0}/ibs.txt"}}
exon_genotypes: {{run: True, exon_counts_file: "{0}/exons.tsv", output_file_prefix: "exon", n_nbr: 3}}
"""


def example(spark, tmp_path, names, with_alignments):
    import random

    rng = random.Random(4)
    for folder in ("depth", "data"):
        os.makedirs(tmp_path / folder)
    write(tmp_path / "ref.fa", "x")
    write(tmp_path / "s.txt", "\n".join(names))
    write(tmp_path / "mask.bed", "chr6\t3100\t3200\n")
    write(tmp_path / "exons.tsv", "".join(f"{n}.cram\t{rng.randrange(5, 9)}\t5\t3\t7\n" for n in names))
    write(tmp_path / "ibs.txt", "ID\thap\tn\tl\te\tnbr\thn\n" + "".join(f"{a}\t{h}\t0\t1\t1\t{rng.choice(names)}\t{rng.choice((1, 2))}\n" for a in names for h in (1, 2) for _ in range(3)))
    for n in names:
        write(tmp_path / "depth" / f"{n}.regions.bed.gz", "".join(f"chr6\t{j * 1000}\t{j * 1000 + 1000}\t{rng.uniform(25, 60):.2f}\n" for j in range(8)))
    aln = [(n, "chr6", 10 * i, 83, 60, "chr6", 10 * i + 100) for n in with_alignments for i in range(30)]
    spark.createDataFrame(aln, 'sample_id string, chrom string, pos long, flag int, mapq int, next_chrom string, end long').write.parquet(str(tmp_path / "data" / "alignments"))
    return Config.read(write(tmp_path / "c.yaml", EXAMPLE.format(tmp_path)))


def test_nested_sections_run(spark, tmp_path):
    """Normalisation and neighbours inside the depth step, the haploid input by its method; samples without a file are
    left out, such with a file that gives nothing are errors, and neither counts as 0 reads."""
    names = [f"S{i:02d}" for i in range(8)]
    config = example(spark, tmp_path, names, names[2:])
    write(tmp_path / "data" / "S01.cram", "x")
    report = config.validate()
    assert report.errors == [] and not any("not known" in w for w in report.warnings)
    done = Pipeline(config).run(spark)
    assert list(done) == ["count_reads", "mosdepth", "normalize", "neighbors", "compute_diploid_genotypes", "compute_haploid_genotypes", "exon_genotypes"]
    assert rows(done["count_reads"]) == [(n, 30) for n in names[2:]]
    lines = [x for p in (tmp_path / "out" / "read_counts").glob("part-*") for x in p.read_text().splitlines()]
    assert "S01\tError" in lines and not any(x.startswith("S00") for x in lines)
    assert {r["sample_id"] for r in done["compute_diploid_genotypes"].collect()} == set(names[2:]) and done["exon_genotypes"].count() == 8
    write(tmp_path / "exons.tsv", "other\t1\t1\t1\t1\n")
    with pytest.raises(ValueError, match="no sample"):
        Pipeline(config).exons(spark)


def test_unknown_names_are_told(tmp_path):
    base = good(tmp_path)
    warnings = Config({**base, "colour": 1, "mosdepth": {"run": True, "binsize": 5, "normalize": {"run": False, "max": 3}}}).validate().warnings
    assert sum("not known" in w for w in warnings) == 3
    both = Config({**base, "mosdepth": {"neighbors": {"run": True, "num_neighbors": 7}}})
    assert both.enabled("neighbors") and both.step("neighbors")["num_neighbors"] == 7 and both.step("mosdepth")["work_dir"] == f"{base['output_dir']}/mosdepth_workdir"
    assert Config({"compute_haploid_genotypes": {"method": "ibd", "ibd_output": "x", "ibs_output": "y"}}).step("compute_haploid_genotypes")["neighbor_file"] == "x"


def test_sam_ends_and_overlap(spark, tmp_path):
    lines = ["@HD", "r\t83\tchr6\t101\t60\t10S90M2D8M\t=", "r\t83\tchr6\t195\t60\t*\tchr7", "r\t83\tchr6\t300\t60\t5M100N5M\t="]
    own = text.read_sam(spark, write(tmp_path / "a.sam", "\n".join(lines)), "S")
    assert [(r["pos"], r["end"]) for r in own.orderBy("pos").collect()] == [(100, 200), (194, 195), (299, 409)]
    assert [r["pos"] for r in reads.region_slice(own, "chr6", 195, 305).orderBy("pos").collect()] == [100, 299]
    assert [r["pos"] for r in reads.region_slice(own.drop("end"), "chr6", 194, 300).orderBy("pos").collect()] == [194, 299]


def test_whole_run_over_files(spark, tmp_path):
    import random

    rng = random.Random(4)
    names = [f"S{i:02d}" for i in range(8)]
    base = good(tmp_path) | {"start_bp": 0, "end_bp": 8000, "directory_loc": str(tmp_path / "data")}
    write(tmp_path / "s.txt", "\n".join(names))
    os.makedirs(tmp_path / "depth")
    os.makedirs(tmp_path / "data")
    for n in names:
        write(tmp_path / "depth" / f"{n}.regions.bed.gz", "".join(f"chr6\t{j * 1000}\t{j * 1000 + 1000}\t{rng.uniform(25, 60):.2f}\n" for j in range(8)))
        write(tmp_path / "data" / f"{n}.cram", "x")
    aln = [(n, "chr6", rng.randrange(8000), 83, 60, "chr6") for n in names for _ in range(rng.randrange(20, 60))]
    spark.createDataFrame(aln, "sample_id string, chrom string, pos long, flag int, mapq int, next_chrom string").write.parquet(str(tmp_path / "data" / "alignments"))
    write(tmp_path / "mask.bed", "chr6\t3100\t3200\n")
    write(tmp_path / "ibs.txt", "ID\thap\tn\tl\te\tnbr\thn\n" + "".join(f"{a}\t{h}\t0\t1\t1\t{rng.choice(names)}\t{rng.choice((1, 2))}\n" for a in names for h in (1, 2) for _ in range(3)))
    base |= {
        "index": {"run": True}, "count_reads": {"run": True, "flags": [83]}, "mosdepth": {"run": True, "work_dir": str(tmp_path / "depth" / "*.bed.gz")},
        "normalize": {"run": True, "repeat_mask_file": str(tmp_path / "mask.bed")}, "neighbors": {"run": True, "num_neighbors": 3}, "compute_diploid_genotypes": {"run": True, "n_nbr": 3},
        "compute_haploid_genotypes": {"run": True, "neighbor_file": str(tmp_path / "ibs.txt"), "n_iters": 4},
    }
    done = Pipeline(Config(base)).run(spark)
    assert list(done) == ["index", "count_reads", "mosdepth", "normalize", "neighbors", "compute_diploid_genotypes", "compute_haploid_genotypes"]
    assert {r["status"] for r in done["index"].collect()} == {"missing_index"}
    assert done["compute_haploid_genotypes"].count() == 8 and done["neighbors"].count() == 24
    with pytest.raises(Exception):
        Pipeline(Config({**base, "compute_haploid_genotypes": {"run": True, "method": "x", "neighbor_file": ""}})).haploid(spark)
    Pipeline(Config(base)).remove_tables(spark)
    assert not (tmp_path / "out" / "tables").exists()
    assert "index" in Pipeline(Config({**base, "normalize": {"run": True, "repeat_mask_file": "/none"}}), fail_fast=False).run(spark)


def test_arrivals(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    write(tmp_path / "in" / "S1.bed", "chr6\t0\t10\t2.0\nbad\n")
    for _ in range(2):
        arrivals.ingest(arrivals.depth_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        write(tmp_path / "in" / "S2.bed", "chr6\t0\t10\t4.0\n")
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("sample_id", "depth")) == [("S1", 2.0), ("S2", 4.0)]
    sums = arrivals.coverage_sums(arrivals.depth_stream(spark, str(tmp_path / "in")), "chr6", 0, 5)
    q = sums.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("sums")) == [("S1", 10.0, 5), ("S2", 20.0, 5)]
