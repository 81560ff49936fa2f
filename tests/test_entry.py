"""The registered queries against their SQL on the smallest tables."""

import math
import os
import subprocess
import sys
import time

import duckdb
import pytest

import __spark_entry__
from strandlake.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["region_coverage", "regions_coverage", "count_reads", "bins_unmasked", "region_stats", "matrix_pivot", "ibs_edges", "ibd_weighted", "phase_gauss_seidel", "haplotype_output", "genetic_map_interp", "file_status", "diploid_cn", "missing_neighbors", "cn_summary", "bam_region", "bam_counts", "depth_read", "bam_depth", "find_file_contains", "sample_list", "dipcn_read", "matrix_cells"]


def show(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


def same(spark, name, run, sql):
    df = run(spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(show(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(show(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, name):
    same(spark, name, queries.REGISTRY[name], oracle.ORACLE[name])


def test_phasing_reads_its_tables_once(spark):
    """Rounds and outputs read what was written, not the match lines again."""
    read = [f for df in queries._phasing(spark, SF) for f in df.inputFiles()]
    assert read and not any("lineitem" in f for f in read)


def test_every_query_has_sql():
    assert set(oracle.ORACLE) == set(queries.REGISTRY)
    assert set(oracle.ORACLE) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part():
    """Where a library of the optional part is missing, the others' queries are there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(__spark_entry__.__file__), check=True)
    assert out.stdout.split() == [str(len(queries.REGISTRY)), "False"]


def test_tables_are_deleted_at_the_end(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; from strandlake.tables import materialize; import glob\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        f"print(materialize(s.range(3), 'x').count(), len(glob.glob('{tmp_path}/*/x')))"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(__spark_entry__.__file__), check=True)
    assert out.stdout.split()[-2:] == ["3", "1"]
    for _ in range(40):
        if not list(tmp_path.glob("strandlake-*")):
            break
        time.sleep(0.25)
    assert not list(tmp_path.glob("strandlake-*"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["sample_id", "dip_cn"]
