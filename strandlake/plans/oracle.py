"""The same queries in DuckDB SQL, written from the definitions. One prelude of views; each query selects from it."""

from __future__ import annotations

from strandlake.plans import synth as S

_PRELUDE = f"""
WITH RECURSIVE
samples AS (SELECT printf('S%05d', s_suppkey) AS sample_id, s_suppkey AS idx FROM supplier),
n AS (SELECT count(*) AS n FROM samples),
aln AS (
  SELECT printf('S%05d', l_suppkey) AS sample_id, 'chr' || (l_orderkey % 3 + 5) AS chrom, (l_orderkey * 7919 + l_partkey * 104729) % 100000 AS pos,
    ({S.FLAG_OF_LINE}::INTEGER[])[l_linenumber] AS flag, (l_quantity::INTEGER - 1)::INTEGER AS mapq,
    CASE WHEN l_discount >= 0.095::DOUBLE THEN 'chrX' ELSE 'chr' || (l_orderkey % 3 + 5) END AS next_chrom,
    (l_orderkey * 7919 + l_partkey * 104729) % 100000 + 100 + 20 * l_linenumber AS "end"
  FROM lineitem),
bins AS (
  SELECT printf('S%05d', l_suppkey) AS sample_id, 'chr6' AS chrom, (m * 1000)::BIGINT AS start, (m * 1000 + 1000)::BIGINT AS "end",
    CASE WHEN count(*) = 1 THEN 0::DOUBLE ELSE sum(l_quantity) / 4 END AS depth
  FROM (SELECT *, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS m FROM lineitem) GROUP BY l_suppkey, m),
mask AS (
  SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'chr6' ELSE '6' END AS chrom, n_nationkey * 10300 AS start, n_nationkey * 10300 + 200 AS "end" FROM nation WHERE n_nationkey < 8),
mask_cells AS (
  SELECT DISTINCT CASE WHEN chrom LIKE 'chr%' THEN chrom ELSE 'chr' || chrom END AS chrom, unnest(range(start // 1000, "end" // 1000 + 1))::BIGINT AS kb FROM mask),
touching AS (SELECT * FROM bins WHERE depth > 0 AND "end" >= {S.START} AND start <= {S.END}),
usable AS (SELECT * FROM touching b WHERE NOT EXISTS (SELECT 1 FROM mask_cells k WHERE k.chrom = b.chrom AND k.kb BETWEEN b.start // 1000 AND b."end" // 1000)),
means AS (SELECT start, "end", avg(depth) AS mean_depth FROM usable GROUP BY start, "end"),
good AS (SELECT * FROM means WHERE mean_depth >= {S.MIN_DEPTH} AND mean_depth <= {S.MAX_DEPTH}),
cells AS (SELECT sample_id, u.start, u."end", depth FROM usable u JOIN good g ON u.start = g.start AND u."end" = g."end"),
scales AS (SELECT sample_id, avg(depth) AS scale FROM cells GROUP BY sample_id),
xs AS (SELECT sample_id, start, "end", depth / scale AS x FROM cells JOIN scales USING (sample_id)),
mus AS (SELECT start, "end", avg(x) AS mu FROM xs GROUP BY start, "end"),
stats AS (
  SELECT start, "end", mu, var, CASE WHEN mu > 0 THEN 100 * var / mu END AS ratio
  FROM (SELECT x.start, x."end", any_value(mu) AS mu, sum((x - mu) * (x - mu)) / ((SELECT count(DISTINCT sample_id) FROM cells) - 1) AS var
        FROM xs x JOIN mus m ON x.start = m.start AND x."end" = m."end" GROUP BY x.start, x."end")),
med AS (SELECT median(ratio) AS median_ratio, CASE WHEN median(ratio) > 0 THEN 1 / sqrt(median(ratio) / 100) ELSE 1::DOUBLE END AS c FROM stats),
zs AS (
  SELECT sample_id, x.start, x."end", c * (CASE WHEN mu > 0 THEN (x - mu) / sqrt(mu) ELSE x END) AS z
  FROM xs x JOIN mus m ON x.start = m.start AND x."end" = m."end", med),
ranked AS (SELECT *, row_number() OVER (ORDER BY ratio) - 1 AS place, count(*) OVER () AS known FROM stats WHERE ratio IS NOT NULL),
selected AS (SELECT start, "end", mu, var, ratio FROM ranked WHERE ratio > (SELECT ratio FROM ranked WHERE place = floor({S.TOP_FRAC} * known))),
z_sel AS (SELECT sample_id, z.start, z."end", z FROM zs z JOIN selected s ON z.start = s.start AND z."end" = s."end"),
feats AS (
  SELECT i.sample_id, s.start, s."end", greatest(-2::DOUBLE, least(2::DOUBLE, coalesce(z, 0))) AS f
  FROM (SELECT DISTINCT sample_id FROM z_sel) i CROSS JOIN selected s LEFT JOIN z_sel z ON z.sample_id = i.sample_id AND z.start = s.start AND z."end" = s."end"),
vecs AS (SELECT sample_id, list(f ORDER BY start, "end") AS v FROM feats GROUP BY sample_id),
pairs AS (SELECT a.sample_id AS a, b.sample_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vecs a JOIN vecs b ON a.sample_id <> b.sample_id),
near AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM pairs QUALIFY rank <= {S.K}),
neighbors AS (
  SELECT a AS sample_id, coalesce(s.scale, 1) AS scale, rank::INTEGER AS rank, b AS nbr_id, coalesce(o.scale, 1) AS nbr_scale, d AS sq_dist,
    d / (2 * greatest(1, (SELECT count(*) FROM selected))) AS norm_dist
  FROM near LEFT JOIN scales s ON s.sample_id = a LEFT JOIN scales o ON o.sample_id = b),
counted AS (
  SELECT s.sample_id, idx, count(a.pos)::BIGINT AS reads FROM samples s LEFT JOIN (
    SELECT * FROM aln WHERE flag IN ({', '.join(map(str, S.FLAGS))}) AND mapq >= 1 AND chrom = next_chrom AND flag & 1024 = 0 AND flag & 256 = 0
      AND chrom = 'chr6' AND pos >= {S.READ_START} AND pos < {S.READ_END}) a ON a.sample_id = s.sample_id
  GROUP BY s.sample_id, idx),
some_reads AS (SELECT sample_id, reads FROM counted WHERE idx % 7 <> 0),
dip AS (
  SELECT sample_id, (any_value(own) / any_value(scale)) / nullif(avg(reads / nbr_scale), 0) AS dip_cn
  FROM (SELECT n.sample_id, n.scale, o.reads AS own, r.reads, nbr_scale, row_number() OVER (PARTITION BY n.sample_id ORDER BY rank) AS nth
        FROM neighbors n JOIN counted o ON o.sample_id = n.sample_id JOIN counted r ON r.sample_id = n.nbr_id)
  WHERE nth <= 10 GROUP BY sample_id),
exons AS (
  SELECT printf('S%05d', l_suppkey) AS sample_id, count_if(l_returnflag = 'A' AND l_linestatus = 'F') AS kiv3, count_if(l_returnflag = 'N' AND l_linestatus = 'O') AS kiv2,
    count_if(l_returnflag = 'R' AND l_linestatus = 'F') AS tied, count_if(l_returnflag = 'N' AND l_linestatus = 'F') AS exon1a FROM lineitem GROUP BY l_suppkey),
kinds AS (
  SELECT sample_id, unnest(['1A', '1B', '1B_KIV3', '1B_notKIV3']) AS kind, unnest([exon1a, kiv3 + kiv2 + tied, kiv3, kiv2 + tied]) AS own FROM exons),
exon_dip AS (
  SELECT kind, sample_id, x / m AS dip_cn FROM (
    SELECT o.kind, n.sample_id, any_value(o.own / scale) AS x, avg(r.own / nbr_scale) AS m
    FROM neighbors n JOIN kinds o ON o.sample_id = n.sample_id JOIN kinds r ON r.sample_id = n.nbr_id AND r.kind = o.kind
    WHERE rank <= 10 AND o.own > 0 AND r.own > 0 AND scale > 0 AND nbr_scale > 0 GROUP BY ALL) WHERE m > 0),
est AS (
  SELECT a.sample_id, 34.9::DOUBLE * a.dip_cn + 5.2::DOUBLE * b.dip_cn - 1 AS dip FROM exon_dip a JOIN exon_dip b USING (sample_id) WHERE a.kind = '1A' AND b.kind = '1B'),
listing AS (
  SELECT unnest(list_filter(['/data/' || sample_id || '_v1_x.cram', CASE WHEN idx % 4 = 1 THEN '/data/' || sample_id || '_v1_x.cram.crai' WHEN idx % 4 = 2 THEN '/data/' || sample_id || '_v1_x.crai' END], lambda p: p IS NOT NULL)) AS path
  FROM samples WHERE idx % 9 <> 0),
status AS (SELECT sample_id, CASE WHEN idx % 9 = 0 THEN 'missing_file' WHEN idx % 4 IN (1, 2) THEN 'has_index' ELSE 'missing_index' END AS status FROM samples),
ibs AS (
  SELECT 2 * l_suppkey + hap - 1 AS node, 2 * (l_partkey % (SELECT n FROM n)) + l_orderkey % 2 AS nbr,
    row_number() OVER (PARTITION BY l_suppkey, hap ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank
  FROM (SELECT *, l_linenumber % 2 + 1 AS hap FROM lineitem) WHERE NOT (l_suppkey % 10 = 0 AND hap = 2) QUALIFY rank <= 10),
edges AS MATERIALIZED (SELECT node::BIGINT AS node, rank::INTEGER AS rank, nbr::BIGINT AS nbr, 1::DOUBLE AS w FROM ibs),
segs AS (
  SELECT *, bp1 + l_quantity::BIGINT * 1000 AS bp2, l_quantity / 10 AS length, 1 - 2.5::DOUBLE * l_discount AS match,
    2 * l_suppkey + l_linenumber % 2 AS a, 2 * (l_partkey % (SELECT n FROM n)) + l_orderkey % 2 AS b
  FROM (SELECT *, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 1000 AS bp1 FROM lineitem)),
dist AS (SELECT *, CASE WHEN bp2 < 900000 THEN 900000 - bp2 WHEN bp1 > 1100000 THEN bp1 - 1100000 ELSE 0 END::BIGINT AS distance FROM segs),
sides AS (
  SELECT a AS node, b AS nbr, 0 AS side, * FROM dist WHERE length >= 0.5 AND match >= 0.7::DOUBLE
  UNION ALL SELECT b, a, 1, * FROM dist WHERE length >= 0.5 AND match >= 0.7::DOUBLE),
irrs AS (SELECT l_suppkey AS idx, sum(l_extendedprice) / 1e7 AS irr FROM lineitem GROUP BY l_suppkey),
deg AS (SELECT node, count(*) AS d FROM edges GROUP BY node),
start_state AS MATERIALIZED (
  SELECT i.idx, irr, CASE WHEN a.d >= 1 AND b.d >= 1 THEN irr / 2 END AS h FROM irrs i LEFT JOIN deg a ON a.node = 2 * i.idx LEFT JOIN deg b ON b.node = 2 * i.idx + 1),
"""


def _jacobi(before: str, after: str) -> str:
    return f"""
{after}_v AS (SELECT 2 * idx AS node, h0 AS v FROM {before} UNION ALL SELECT 2 * idx + 1, h1 FROM {before}),
{after}_m AS (SELECT e.node, sum(w * v) / (1e-9 + sum(w)) AS m FROM edges e JOIN {after}_v x ON x.node = e.nbr WHERE v IS NOT NULL GROUP BY e.node),
{after} AS (
  SELECT s.idx, irr, CASE WHEN h0 IS NULL THEN NULL WHEN coalesce(a.m, 0) + coalesce(b.m, 0) > 0 THEN irr * coalesce(a.m, 0) / (coalesce(a.m, 0) + coalesce(b.m, 0)) ELSE h0 END AS h0,
    CASE WHEN h1 IS NULL THEN NULL WHEN coalesce(a.m, 0) + coalesce(b.m, 0) > 0 THEN irr * coalesce(b.m, 0) / (coalesce(a.m, 0) + coalesce(b.m, 0)) ELSE h1 END AS h1
  FROM {before} s LEFT JOIN {after}_m a ON a.node = 2 * s.idx LEFT JOIN {after}_m b ON b.node = 2 * s.idx + 1),"""


_JACOBI = "j0 AS (SELECT idx, irr, h AS h0, h AS h1 FROM start_state)," + _jacobi("j0", "j1") + _jacobi("j1", "j2") + _jacobi("j2", "j3")

_SWEEP = """
lists AS MATERIALIZED (
  SELECT s.idx, s.irr, s.h, coalesce((SELECT list(nbr ORDER BY rank) FROM edges e WHERE e.node = 2 * s.idx), []) AS e0,
    coalesce((SELECT list(nbr ORDER BY rank) FROM edges e WHERE e.node = 2 * s.idx + 1), []) AS e1 FROM start_state s),
sw(step, st) AS (
  SELECT 0::BIGINT, (SELECT flatten(list([h, h] ORDER BY idx)) FROM start_state)
  UNION ALL
  SELECT step + 1, CASE WHEN h IS NULL OR m0 + m1 <= 0 THEN st ELSE list_concat(list_concat(st[1 : 2 * idx], [irr * m0 / (m0 + m1), irr * m1 / (m0 + m1)]), st[2 * idx + 3 :]) END
  FROM (SELECT step, st, idx, irr, h,
      coalesce(list_sum(list_transform(e0, lambda x: st[x + 1])), 0) / (1e-9 + len(list_filter(e0, lambda x: st[x + 1] IS NOT NULL))) AS m0,
      coalesce(list_sum(list_transform(e1, lambda x: st[x + 1])), 0) / (1e-9 + len(list_filter(e1, lambda x: st[x + 1] IS NOT NULL))) AS m1
    FROM sw JOIN lists ON lists.idx = sw.step % (SELECT count(*) FROM start_state) WHERE step < 4 * (SELECT count(*) FROM start_state))),
gs AS (SELECT s.idx, irr, st[2 * s.idx + 1] AS h0, st[2 * s.idx + 2] AS h1 FROM start_state s, (SELECT st FROM sw ORDER BY step DESC LIMIT 1)),
gv AS (SELECT 2 * idx AS node, h0 AS v FROM gs UNION ALL SELECT 2 * idx + 1, h1 FROM gs),
gm AS (SELECT e.node, sum(w * v) / (1e-9 + sum(w)) AS m FROM edges e JOIN gv x ON x.node = e.nbr WHERE v IS NOT NULL GROUP BY e.node),"""


def _sql(select: str, more: str = "") -> str:
    return _PRELUDE + more + " last_view AS (SELECT 1)\n" + select


def _edges_of(where: str, w: str) -> str:
    order = "length DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, side"
    return f"SELECT node::BIGINT AS node, rank::INTEGER AS rank, nbr::BIGINT AS nbr, {w} AS w FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {order}) AS rank FROM sides WHERE {where}) WHERE rank <= 10"


_REGIONS = "SELECT printf('r%02d', range) AS region, range * 1700 AS a, range * 1700 + 2600 AS b FROM range(40)"
_RATIO = 'SELECT start, "end", round(ratio, 6) AS ratio FROM ranked WHERE '

ORACLE: dict[str, str] = {
    "region_coverage": _sql("""SELECT s.sample_id, coalesce(round_even(100 * sum(depth * ov) / sum(ov), 0), 0)::BIGINT AS coverage FROM samples s
        LEFT JOIN (SELECT *, least("end", 41250) - greatest(start, 20500) AS ov FROM bins WHERE least("end", 41250) - greatest(start, 20500) > 0) b USING (sample_id) GROUP BY s.sample_id"""),
    "regions_coverage": _sql(f"""SELECT sample_id, region, round_even(sum(depth * ov) / sum(ov) * 100, 0)::BIGINT AS coverage
        FROM (SELECT *, least("end", b) - greatest(start, a) AS ov FROM bins JOIN ({_REGIONS}) ON start < b AND "end" > a) GROUP BY sample_id, region"""),
    "count_reads": _sql("SELECT sample_id, reads FROM counted"),
    "count_reads_dup_flags": _sql("SELECT sample_id, 0::BIGINT AS reads FROM samples"),
    "region_slice": _sql("SELECT * FROM aln WHERE chrom = 'chr6' AND pos < 24000 AND \"end\" > 20000"),
    "bam_region": _sql("SELECT * FROM aln WHERE chrom = 'chr6' AND pos < 24000 AND \"end\" > 20000"),
    "bam_depth": _sql("""SELECT s.sample_id, chrom, (b * 1000)::BIGINT AS start, least(b * 1000 + 1000, 100500)::BIGINT AS "end", round(coalesce(n, 0)::DOUBLE / least(1000, 100500 - b * 1000), 6) AS depth
        FROM (SELECT sample_id FROM samples) s CROSS JOIN (SELECT unnest(['chr5', 'chr6', 'chr7']) AS chrom) CROSS JOIN (SELECT range AS b FROM range(101)) LEFT JOIN (
          SELECT sample_id, chrom, place // 1000 AS b, count(*) AS n
          FROM (SELECT sample_id, chrom, unnest(range(pos, pos + 40) || range(pos + 50, "end" - 10)) AS place FROM aln) WHERE place < 100500 GROUP BY ALL) USING (sample_id, chrom, b)"""),
    "find_file_contains": _sql("""SELECT n.sample_id, min(path) AS path
        FROM (SELECT sample_id FROM samples UNION SELECT 'S' || idx FROM samples UNION SELECT printf('%03d', idx % 1000) FROM samples) n
        LEFT JOIN (SELECT '/data/run' || idx % 7 || CASE WHEN idx % 2 = 0 THEN '_' ELSE '-S' END || idx || '.' || sample_id || '_x.cram' AS path FROM samples WHERE idx % 5 <> 0) f
          ON replace(path, '/data/', '') LIKE '%' || n.sample_id || '%.cram' GROUP BY n.sample_id"""),
    "bam_counts": _sql("SELECT sample_id, reads FROM counted"),
    "depth_read": _sql('SELECT sample_id, chrom, start, "end", depth FROM bins'),
    "slices_written": _sql("SELECT * FROM aln WHERE chrom = 'chr6' AND pos < 24000 AND \"end\" > 20000"),
    "reads_of_files": _sql("""SELECT sample_id, CASE WHEN idx % 5 <> 0 THEN reads END AS reads FROM counted WHERE idx % 9 <> 0 OR idx % 5 <> 0"""),
    "sam_alignments": _sql("""SELECT * REPLACE ('one' AS sample_id) FROM aln WHERE chrom = 'chr7'"""),
    "sample_list": _sql("SELECT sample_id, (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS ord FROM samples"),
    "mask_read": _sql('SELECT chrom, start::BIGINT AS start, "end"::BIGINT AS "end" FROM mask'),
    "matrix_ratios": _sql("""SELECT (row_number() OVER (ORDER BY start, "end") - 1)::INTEGER AS at, printf('%.3f', ratio)::DOUBLE AS ratio FROM selected"""),
    "matrix_scales": _sql("SELECT sample_id, printf('%.2f', scale)::DOUBLE AS scale FROM scales"),
    "matrix_cells": _sql("""SELECT sample_id, place AS "at", printf('%.2f', z)::DOUBLE + 0 AS z FROM z_sel
        JOIN (SELECT start, "end", (row_number() OVER (ORDER BY start, "end") - 1)::INTEGER AS place FROM selected) USING (start, "end")"""),
    "neighbors_read": _sql("SELECT sample_id, printf('%.2f', scale)::DOUBLE AS scale, rank, nbr_id, printf('%.2f', nbr_scale)::DOUBLE AS nbr_scale, printf('%.2f', norm_dist)::DOUBLE AS norm_dist FROM neighbors"),
    "counts_read": _sql("SELECT sample_id, reads::DOUBLE AS reads FROM counted WHERE idx % 5 <> 0"),
    "exon_counts_read": _sql("SELECT * FROM exons"),
    "exon_dipcn_read": _sql("SELECT sample_id, printf('%.6f', dip_cn)::DOUBLE AS irr FROM exon_dip WHERE kind = '1A'"),
    "dipcn_read": _sql("SELECT sample_id, (row_number() OVER (ORDER BY sample_id) - 1)::BIGINT AS idx, printf('%.6f', dip_cn)::DOUBLE AS irr FROM exon_dip WHERE kind = '1B'"),
    "ibs_read": "SELECT printf('S%05d', l_suppkey) AS id, l_linenumber % 2 + 1 AS hap, printf('S%05d', l_partkey % 90) AS nbr_id, (l_orderkey % 2 + 1)::INTEGER AS nbr_hap FROM lineitem",
    "ibd_read": _sql("SELECT printf('S%05d', l_suppkey) AS id1, printf('S%05d_%d', l_suppkey, l_linenumber % 2) AS hap1, printf('S%05d', l_partkey % (SELECT n FROM n)) AS id2, printf('S%05d_%d', l_partkey % (SELECT n FROM n), l_orderkey % 2) AS hap2, bp1::BIGINT AS bp1, bp2::BIGINT AS bp2, round(length, 6) AS length, round(match, 6) AS match FROM segs"),
    "genetic_map_read": "SELECT p_partkey * 1000 AS position, round(sum(p_retailprice) OVER (ORDER BY p_partkey) / 1e5, 6) AS cm FROM part WHERE p_partkey % 10 = 0",
    "map_written": "SELECT CASE WHEN p_partkey % 2 = 0 THEN '6' ELSE 'chr6' END AS chr, 'rs' || p_partkey AS snp, p_partkey / 8 AS cm, p_partkey * 100 AS bp FROM part WHERE p_partkey % 3 <> 0",
    "loci_read": "SELECT 'chr6' AS chrom, p_partkey * 1000 AS start, p_partkey * 1000 + 501 AS \"end\", p_brand AS name FROM part",
    "panel_read": "SELECT printf('S%05d', s_suppkey) AS sample_id, printf('P%d', s_nationkey) AS population FROM supplier",
    "haplotypes_written": _sql(
        """SELECT sample_id AS "ID", printf('%.2f', irr) AS "IRRs", coalesce(printf('%.2f', h0), 'nan') AS hap1phased, coalesce(printf('%.2f', h1), 'nan') AS hap2phased,
          printf('%.2f', coalesce(a.m, f)) AS hap1imp, printf('%.2f', coalesce(b.m, f)) AS hap2imp
        FROM gs JOIN samples USING (idx) LEFT JOIN gm a ON a.node = 2 * idx LEFT JOIN gm b ON b.node = 2 * idx + 1, (SELECT coalesce(avg(irr) / 2, 0) AS f FROM gs WHERE h0 IS NOT NULL)""",
        _SWEEP,
    ),
    "extreme_columns": _sql("SELECT count_if(ratio > (SELECT median(ratio) FROM stats))::BIGINT AS extreme FROM stats"),
    "phasable": _sql("SELECT count(*)::BIGINT AS samples, round(avg(irr), 6) AS mean_irr, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(DISTINCT node) FROM edges), 6) AS mean_degree FROM start_state WHERE h IS NOT NULL"),
    "read_totals": _sql("SELECT count(*)::BIGINT AS samples, sum(reads)::BIGINT AS reads FROM counted"),
    "mask_kb": _sql("SELECT * FROM mask_cells"),
    "bins_in_region": _sql("SELECT * FROM touching"),
    "bins_unmasked": _sql("SELECT * FROM usable"),
    "population_mean_depth": _sql('SELECT start, "end", round(mean_depth, 6) AS mean_depth FROM means'),
    "valid_regions": _sql('SELECT start, "end", round(mean_depth, 6) AS mean_depth FROM good'),
    "valid_bins": _sql("SELECT * FROM cells"),
    "sample_scale": _sql("SELECT sample_id, round(scale, 6) AS scale FROM scales"),
    "row_normalized": _sql('SELECT sample_id, start, "end", round(x, 6) AS x FROM xs'),
    "region_stats": _sql('SELECT start, "end", round(mu, 6) AS mu, round(var, 6) AS var, round(ratio, 6) AS ratio FROM stats'),
    "median_rescale": _sql("SELECT round(median_ratio, 6) AS median_ratio, round(c, 6) AS c FROM med"),
    "z_matrix": _sql('SELECT sample_id, start, "end", round(z, 6) AS z FROM zs'),
    "selected_regions": _sql('SELECT start, "end", round(mu, 6) AS mu, round(var, 6) AS var, round(ratio, 6) AS ratio FROM selected'),
    "z_selected": _sql('SELECT sample_id, start, "end", round(z, 6) AS z FROM z_sel'),
    "matrix_pivot": _sql("SELECT sample_id, " + ", ".join(f"max(CASE WHEN start = {s} THEN depth END) AS b{s}" for s in (10000, 20000, 30000, 40000, 50000)) + " FROM bins WHERE start IN (10000, 20000, 30000, 40000, 50000) GROUP BY sample_id"),
    "clip_impute": _sql('SELECT sample_id, start, "end", round(f, 6) AS f FROM feats'),
    "variance_filter": _sql(_RATIO + "ratio >= (SELECT ratio FROM ranked WHERE place = 0) AND ratio <= (SELECT round(max(ratio) * 0.9::DOUBLE, 3) FROM ranked)"),
    "variance_filter_frac": _sql(_RATIO + "ratio >= (SELECT ratio FROM ranked WHERE place = least(floor((SELECT count(*) FROM stats) * 0.5::DOUBLE), known - 1)) AND ratio <= 1000"),
    "pairwise_distance": _sql("SELECT a, b, round(d, 6) AS sq_dist FROM pairs JOIN samples s ON s.sample_id = a WHERE b = printf('S%05d', s.idx + 1)"),
    "nearest_neighbors": _sql("SELECT sample_id, round(scale, 6) AS scale, rank, nbr_id, round(nbr_scale, 6) AS nbr_scale, round(sq_dist, 6) AS sq_dist, round(norm_dist, 6) AS norm_dist FROM neighbors"),
    "embedding_knn": """SELECT a AS vec_id, rank::INTEGER AS rank, b AS nbr_id, round(d, 6) AS sq_dist FROM (
        SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM (
          SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
          FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)) WHERE rank <= 5""",
    "diploid_cn": _sql("SELECT sample_id, round(dip_cn, 6) AS dip_cn FROM dip WHERE dip_cn IS NOT NULL"),
    "missing_neighbors": _sql("SELECT nbr_id, count(*)::BIGINT AS lists FROM neighbors WHERE nbr_id NOT IN (SELECT sample_id FROM some_reads) GROUP BY nbr_id"),
    **{name: _sql(f"SELECT sample_id, round(dip_cn, 6) AS dip_cn FROM exon_dip WHERE kind = '{kind}'") for name, kind in (("exon_cn_1a", "1A"), ("exon_cn_1b", "1B"), ("exon_cn_1b_kiv3", "1B_KIV3"), ("exon_cn_1b_notkiv3", "1B_notKIV3"))},
    "normalize_sample_id": "SELECT s_suppkey, s_name AS sample_id, 'chr6' AS chrom FROM supplier",
    "sample_overlap": _sql("SELECT sample_id FROM exons INTERSECT SELECT sample_id FROM some_reads"),
    "file_status": _sql("SELECT * FROM status"),
    "file_status_counts": _sql("SELECT status, count(*)::BIGINT AS samples FROM status GROUP BY status"),
    "accounting": _sql("SELECT *, total - ok - failed AS unaccounted FROM (SELECT count(*)::BIGINT AS total, count_if(idx % 3 = 0)::BIGINT AS ok, count_if(idx % 3 = 1 AND idx % 2 = 0)::BIGINT AS failed FROM samples)"),
    "longest_prefix_sample": _sql("""SELECT path, CASE WHEN substr(path, 8, 5)::BIGINT % 3 = 0 THEN substr(path, 7, 6) || '_v1' ELSE substr(path, 7, 6) END AS sample_id FROM listing"""),
    "locus_lookup": "SELECT 'chr6' AS chrom, p_partkey * 1000 AS start, p_partkey * 1000 + 501 AS \"end\", (p_partkey * 2000 + 501) // 2 AS midpoint FROM part WHERE p_brand = 'Brand#17' ORDER BY p_partkey LIMIT 1",
    "dedup_last_wins": "SELECT l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1",
    "lenient_parse": "SELECT printf('S%05d', o_custkey % 500) AS sample_id, arg_max(o_custkey, o_orderkey)::DOUBLE AS reads FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 GROUP BY o_custkey % 500",
    "ibs_edges": _sql("SELECT * FROM edges"),
    "ibd_edges": _sql(_edges_of("true", "1::DOUBLE")),
    "ibd_weighted": _sql(_edges_of("node <> nbr", "round(1e6 / (distance + 1e6) * match, 6)")),
    "segment_distance": _sql("SELECT distance, count(*)::BIGINT AS segments FROM dist GROUP BY distance"),
    "adjacency_list": _sql("SELECT node, count(*)::BIGINT AS degree, string_agg(nbr::VARCHAR, ',' ORDER BY rank) AS nbrs FROM edges GROUP BY node"),
    "phase_init": _sql("SELECT idx, round(irr, 6) AS irr, round(h, 6) AS h0, round(h, 6) AS h1 FROM start_state"),
    "phase_jacobi_3": _sql("SELECT idx, round(irr, 6) AS irr, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM j3", _JACOBI),
    "phase_gauss_seidel": _sql("SELECT idx, round(irr, 6) AS irr, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM gs", _SWEEP),
    "haplotype_output": _sql(
        """SELECT sample_id, round(irr, 6) AS irrs, round(h0, 6) AS hap1phased, round(h1, 6) AS hap2phased, round(coalesce(a.m, f), 6) AS hap1imp, round(coalesce(b.m, f), 6) AS hap2imp
        FROM gs JOIN samples USING (idx) LEFT JOIN gm a ON a.node = 2 * idx LEFT JOIN gm b ON b.node = 2 * idx + 1, (SELECT coalesce(avg(irr) / 2, 0) AS f FROM gs WHERE h0 IS NOT NULL)""",
        _SWEEP,
    ),
    "genetic_map_interp": """WITH k AS (
        SELECT p_partkey * 1000 AS p, sum(p_retailprice) OVER (ORDER BY p_partkey) / 1e5 AS c FROM part WHERE p_partkey % 10 = 0),
      spans AS (SELECT p, c, lead(p) OVER (ORDER BY p) AS p1, lead(c) OVER (ORDER BY p) AS c1 FROM k),
      q AS (SELECT DISTINCT l_partkey * 997 - 3000 AS bp FROM lineitem)
      SELECT bp, round(CASE WHEN bp <= (SELECT min(p) FROM k) THEN (SELECT arg_min(c, p) FROM k) WHEN p1 IS NULL THEN c ELSE c + (bp - p) * (c1 - c) / (p1 - p) END, 6) AS cm
      FROM q ASOF LEFT JOIN spans ON bp >= p""",
    "cn_estimate": _sql("SELECT sample_id, round(dip, 6) AS dip_estimate, round(dip / 2, 6) AS hap_estimate FROM est"),
    "cn_summary": _sql("SELECT kind, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (SELECT 'dip' AS kind, dip AS v FROM est UNION ALL SELECT 'hap', dip / 2 FROM est) GROUP BY kind"),
    "binned_depth": _sql("""SELECT sample_id, 'chr6' AS chrom, (b * 1000)::BIGINT AS start, (b * 1000 + 1000)::BIGINT AS "end", round(coalesce(bp, 0)::DOUBLE / 1000, 6) AS depth
        FROM (SELECT DISTINCT sample_id FROM aln) CROSS JOIN (SELECT range AS b FROM range(100)) LEFT JOIN (
          SELECT sample_id, b, sum(least(pos + 150, (b + 1) * 1000, 100000) - greatest(pos, b * 1000)) AS bp
          FROM aln JOIN (SELECT range AS b FROM range(100)) ON pos < (b + 1) * 1000 AND pos + 150 > b * 1000 WHERE chrom = 'chr6' GROUP BY sample_id, b) USING (sample_id, b)"""),
    "event_matrix": """WITH c AS (SELECT user_id AS u, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, sum(value) AS depth FROM events GROUP BY ALL),
      s AS (SELECT u, avg(depth) AS scale FROM c GROUP BY u), x AS (SELECT u, day, CASE WHEN scale <> 0 THEN depth / scale END AS x FROM c JOIN s USING (u)),
      m AS (SELECT day, avg(x) AS mu FROM x GROUP BY day),
      v AS (SELECT day, any_value(mu) AS mu, sum((x - mu) * (x - mu)) / ((SELECT count(DISTINCT u) FROM c) - 1) AS var FROM x JOIN m USING (day) GROUP BY day)
      SELECT day::BIGINT AS start, (day + 1)::BIGINT AS "end", round(mu, 6) AS mu, round(var, 6) AS var, round(CASE WHEN mu > 0 THEN 100 * var / mu END, 6) AS ratio FROM v""",
}
