"""Common table expressions for the DuckDB oracles: twins of ``strandlake.sources.fixtures``."""

_SITE = "'chr' || (l_partkey % 5) AS chrm, l_partkey AS pos, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand, l_orderkey AS read_id"

MOD_CALLS = f"""wide AS (SELECT {_SITE}, 9 * max(l_discount) AS p_m, max(l_tax) AS p_h FROM lineitem GROUP BY ALL),
calls AS (SELECT chrm, pos, strand, read_id, 'h' AS mod_base, round(ln(greatest(p_h, 1e-6)), 6) AS score FROM wide
          UNION ALL SELECT chrm, pos, strand, read_id, 'm', round(ln(greatest(p_m, 1e-6)), 6) FROM wide)"""

WINNERS = f"""{MOD_CALLS},
reads AS (SELECT chrm, pos, strand, read_id, max(CASE WHEN mod_base = 'h' THEN score END) AS h, max(CASE WHEN mod_base = 'm' THEN score END) AS m, sum(exp(score)) AS s FROM calls GROUP BY ALL),
winners AS (SELECT chrm, pos, strand, read_id,
              CASE WHEN s < 1 AND ln(1 - s) > greatest(h, m) THEN 'can' WHEN m > h THEN 'm' ELSE 'h' END AS winner,
              CASE WHEN s < 1 AND ln(1 - s) > greatest(h, m) THEN ln(1 - s) ELSE greatest(h, m) END AS win_lp FROM reads)"""

LLRS = f"""{MOD_CALLS},
can AS (SELECT chrm, pos, strand, read_id, ln(1 - sum(exp(score))) AS can_lp FROM calls GROUP BY ALL),
llrs AS (SELECT chrm, pos, strand, read_id, mod_base, can_lp - score AS llr FROM calls JOIN can USING (chrm, pos, strand, read_id))"""

VAR_CALLS = """vw AS (SELECT l_partkey AS locus, l_orderkey AS read_id, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY ALL),
calls AS (SELECT locus, read_id, 'A' AS alt_seq, round(ln(greatest(4 * d, 1e-6)), 6) AS score FROM vw
          UNION ALL SELECT locus, read_id, 'T', round(ln(greatest(5 * t, 1e-6)), 6) FROM vw)"""

DIPLOID = f"""{VAR_CALLS},
sc AS (SELECT locus, read_id, CASE alt_seq WHEN 'A' THEN 1 ELSE 2 END AS a, score FROM calls UNION ALL SELECT locus, read_id, 0, ln(1 - sum(exp(score))) FROM calls GROUP BY ALL),
hom AS (SELECT locus, a AS a1, a AS a2, sum(score) AS lp, count(*) AS n FROM sc GROUP BY ALL),
prs AS (SELECT x.locus, x.read_id, x.a AS a1, y.a AS a2, x.score AS s1, y.score AS s2 FROM sc x JOIN sc y ON x.locus = y.locus AND x.read_id = y.read_id AND x.a < y.a),
rk AS (SELECT locus, a1, a2, row_number() OVER w AS i, sum(s1) OVER w AS p1, sum(s2) OVER w AS p2, sum(s2) OVER (PARTITION BY locus, a1, a2) AS t2, count(*) OVER (PARTITION BY locus, a1, a2) AS n
       FROM prs WINDOW w AS (PARTITION BY locus, a1, a2 ORDER BY s2 - s1, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tm AS (SELECT locus, a1, a2, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2) + p1 + t2 - p2 AS term FROM rk
       UNION ALL SELECT locus, a1, a2, t2 - n * ln(2) FROM rk WHERE i = 1),
het AS (SELECT locus, a1, a2, m + ln(sum(exp(term - m))) AS lp FROM (SELECT *, max(term) OVER (PARTITION BY locus, a1, a2) AS m FROM tm) GROUP BY locus, a1, a2, m),
gt_lp AS (SELECT locus, a1, a2, lp FROM hom UNION ALL SELECT locus, a1, a2, lp FROM het),
zz AS (SELECT locus, m + ln(sum(exp(lp - m))) AS z FROM (SELECT *, max(lp) OVER (PARTITION BY locus) AS m FROM gt_lp) GROUP BY locus, m),
nrm AS (SELECT g.locus, a2 * (a2 + 1) // 2 + a1 AS k, lp - z AS lp FROM gt_lp g JOIN zz USING (locus)),
wide AS (SELECT locus, (SELECT max(n) FROM hom h WHERE h.locus = nrm.locus) AS reads, arg_max(k, (lp, -k))::INTEGER AS gt,
  max(CASE WHEN k = 0 THEN lp END) AS lp00, max(CASE WHEN k = 1 THEN lp END) AS lp01, max(CASE WHEN k = 2 THEN lp END) AS lp11,
  max(CASE WHEN k = 3 THEN lp END) AS lp02, max(CASE WHEN k = 4 THEN lp END) AS lp12, max(CASE WHEN k = 5 THEN lp END) AS lp22 FROM nrm GROUP BY locus)"""

BED = """bed AS (SELECT *, round_even(1000.0 * mod_cov / cov, 0) / 10 AS pct FROM (
  SELECT 'chr' || (l_partkey % 5) AS chrom, l_partkey AS pos, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand, l_returnflag AS sample,
         count(*) AS cov, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS mod_cov FROM lineitem GROUP BY ALL))"""

PAIRED = f"""{BED},
pairs AS (SELECT 100.0 * a.mod_cov / a.cov AS pct_a, 100.0 * b.mod_cov / b.cov AS pct_b FROM (SELECT * FROM bed WHERE sample = 'A' AND cov >= 2) a
          JOIN (SELECT * FROM bed WHERE sample = 'N' AND cov >= 2) b USING (chrom, strand, pos))"""

SEQS = """seqs AS (SELECT doc_id AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"""

INTERVALS = """iv AS (SELECT o_orderkey AS read_id, o_orderkey % 5 AS contig, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS strand, (o_orderkey * 37) % 2000 AS r_st, (o_orderkey * 37) % 2000 + 20 + o_custkey % 80 AS r_en FROM orders),
st AS (SELECT p_partkey % 5 AS contig, p_partkey AS pos, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS strand FROM part)"""

SPANS = """sp AS (SELECT p_partkey % 5 AS contig, p_partkey * 3 AS start, p_partkey * 3 + 1 + (p_partkey * 7) % 23 AS "end", p_partkey AS id, p_size::DOUBLE AS qual FROM part)"""
