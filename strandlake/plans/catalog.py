"""Registered queries of the core engine, with their DuckDB oracles.

``query(sql)`` registers a function under its name; without SQL the driver checks rows only
and the tests compare with plain loops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import expr
from strandlake.operators import calibrate, intervals, mods, resolve, sites, validate, variants
from strandlake.plans import oracles as o
from strandlake.session import read_table, work_dir
from strandlake.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




def r6(c):
    return F.round(c, 6)


ALPHABET = ["h", "m"]


# --- D: modified bases ----------------------------------------------------


@query(f"""WITH {o.WINNERS}
SELECT chrm, pos, strand, mod_base, reads, valid_reads, CASE mod_base WHEN 'h' THEN n_h ELSE n_m END AS n_mod,
       round(CASE WHEN valid_reads > 0 THEN (CASE mod_base WHEN 'h' THEN n_h ELSE n_m END) / valid_reads ELSE 0 END, 6) AS prop
FROM (SELECT chrm, pos, strand, count(*) AS reads, sum(CASE WHEN exp(win_lp) > 0.8 THEN 1 ELSE 0 END)::BIGINT AS valid_reads,
             sum(CASE WHEN exp(win_lp) > 0.8 AND winner = 'h' THEN 1 ELSE 0 END)::BIGINT AS n_h,
             sum(CASE WHEN exp(win_lp) > 0.8 AND winner = 'm' THEN 1 ELSE 0 END)::BIGINT AS n_m
      FROM winners GROUP BY ALL), (VALUES ('h'), ('m')) AS t(mod_base)""")
def mods_binary_threshold(spark, d):
    out = mods.binary_threshold(fx.mod_calls(spark, d), mods=ALPHABET)
    return out.withColumn("prop", r6("prop"))


@query(f"""WITH {o.WINNERS}, w AS (SELECT *, 1 / (1 + exp(-30.0 * (exp(win_lp) - 0.8))) AS w FROM winners)
SELECT chrm, pos, strand, mod_base, reads, round(CASE mod_base WHEN 'h' THEN w_h ELSE w_m END / w_all, 6) AS prop
FROM (SELECT chrm, pos, strand, count(*) AS reads, sum(w) AS w_all, sum(CASE WHEN winner = 'h' THEN w ELSE 0 END) AS w_h, sum(CASE WHEN winner = 'm' THEN w ELSE 0 END) AS w_m
      FROM w GROUP BY ALL), (VALUES ('h'), ('m')) AS t(mod_base)""")
def mods_expit(spark, d):
    return mods.expit_scaled(fx.mod_calls(spark, d), mods=ALPHABET).withColumn("prop", r6("prop"))


@query(f"""WITH RECURSIVE {o.MOD_CALLS},
r AS (SELECT chrm, pos, strand, read_id, exp(max(CASE WHEN mod_base = 'h' THEN score END)) AS h, exp(max(CASE WHEN mod_base = 'm' THEN score END)) AS m FROM calls GROUP BY ALL),
q AS (SELECT chrm, pos, strand, greatest(1 - (h + m), 0) AS c, h, m FROM r),
l AS (SELECT chrm, pos, strand, list({{'c': c, 'h': h, 'm': m}}) AS v, count(*) AS reads, sum(CASE WHEN c >= h AND c >= m THEN 1 ELSE 0 END) / count(*) AS c,
        sum(CASE WHEN h > c AND h >= m THEN 1 ELSE 0 END) / count(*) AS h, sum(CASE WHEN m > c AND m > h THEN 1 ELSE 0 END) / count(*) AS m FROM q GROUP BY ALL),
s AS (SELECT chrm, pos, strand, v, reads, greatest(c, 0.001::DOUBLE) AS c, greatest(h, 0.001::DOUBLE) AS h, greatest(m, 0.001::DOUBLE) AS m FROM l),
em AS (SELECT chrm, pos, strand, v, reads, 0 AS step, c / (c + h + m) AS mc, h / (c + h + m) AS mh, m / (c + h + m) AS mm, false AS done FROM s
  UNION ALL SELECT chrm, pos, strand, v, reads, step + 1, c / (c + h + m), h / (c + h + m), m / (c + h + m), greatest(abs(c / (c + h + m) - mc), abs(h / (c + h + m) - mh), abs(m / (c + h + m) - mm)) < 0.001::DOUBLE
  FROM (SELECT *, greatest(list_avg(list_transform(v, lambda x: x.c * mc / (x.c * mc + x.h * mh + x.m * mm))), 0.001::DOUBLE) AS c, greatest(list_avg(list_transform(v, lambda x: x.h * mh / (x.c * mc + x.h * mh + x.m * mm))), 0.001::DOUBLE) AS h,
          greatest(list_avg(list_transform(v, lambda x: x.m * mm / (x.c * mc + x.h * mh + x.m * mm))), 0.001::DOUBLE) AS m FROM em WHERE step < 15 AND NOT done)),
f AS (SELECT chrm, pos, strand, reads, arg_max(mh, step) AS h, arg_max(mm, step) AS m FROM em GROUP BY chrm, pos, strand, reads),
u AS (SELECT chrm, pos, strand, reads, mod_base, CASE mod_base WHEN 'h' THEN h ELSE m END AS x FROM f, (VALUES ('h'), ('m')) AS t(mod_base))
SELECT chrm, pos, strand, reads, 0::BIGINT AS dropped_reads, mod_base, round(CASE WHEN x <= 0.001::DOUBLE * 1.000001 THEN 0 WHEN x >= 1 - 1.000001 * 2 * 0.001::DOUBLE THEN 1 ELSE x END, 6) AS prop FROM u""")
def mods_em(spark, d):
    return mods.em(fx.mod_calls(spark, d), mods=ALPHABET).withColumn("prop", r6("prop"))


@query(f"""WITH {o.MOD_CALLS}
SELECT chrm, pos, strand, mod_base, string_agg(printf('%.6f', score), ',' ORDER BY score) AS log_probs
FROM (SELECT chrm, pos, strand, read_id, mod_base, max(score) AS score FROM calls GROUP BY ALL) GROUP BY ALL""")
def mods_log_probs(spark, d):
    return mods.log_prob_lists(fx.mod_calls(spark, d))


@query(f"""WITH {o.LLRS} SELECT mod_base, count(*) AS n, round(avg(llr), 6) AS mean_llr, round(min(llr), 6) AS min_llr, round(max(llr), 6) AS max_llr FROM llrs GROUP BY mod_base""")
def mods_llr_stats(spark, d):
    s = mods.llr_summary(mods.site_llrs(fx.mod_calls(spark, d), ALPHABET))
    return s.select("mod_base", "n", *[r6(c).alias(c) for c in ("mean_llr", "min_llr", "max_llr")])


@query(f"""WITH {o.LLRS} SELECT mod_base, count(*) AS n, round(avg(llr), 6) AS mean_llr, round(min(llr), 6) AS min_llr, round(max(llr), 6) AS max_llr
FROM llrs WHERE (chrm, pos, strand) IN (SELECT 'chr' || (p_partkey % 5), p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END FROM part) GROUP BY mod_base""")
def mods_llr_at_sites(spark, d):
    s = fx.interval_sites(spark, d).select(F.concat(F.lit("chr"), F.col("contig").cast("string")).alias("chrm"), "pos", "strand")
    calls = fx.mod_calls(spark, d).join(s.distinct(), fx.SITE, "left_semi")
    out = mods.llr_summary(mods.site_llrs(calls, ALPHABET))
    return out.select("mod_base", "n", *[r6(c).alias(c) for c in ("mean_llr", "min_llr", "max_llr")])


@query(f"""WITH {o.LLRS} SELECT mod_base, CAST(0.3 AS DOUBLE) AS frac_mod, round(quantile_cont(llr, 0.3), 6) AS threshold FROM llrs WHERE mod_base = 'm' GROUP BY mod_base""")
def mods_global_threshold(spark, d):
    return mods.global_threshold(mods.site_llrs(fx.mod_calls(spark, d), ALPHABET), "m", fraction=0.3).withColumn("threshold", r6("threshold"))


@query(f"""WITH {o.LLRS}, x AS (SELECT llr FROM llrs WHERE mod_base = 'm'),
cut AS (SELECT least(abs(quantile_cont(llr, 0.08)), abs(quantile_cont(llr, 0.92))) AS b FROM x),
f AS (SELECT sum(CASE WHEN llr <= -b THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN llr <= -b THEN 1 ELSE 0 END) + sum(CASE WHEN llr >= b THEN 1 ELSE 0 END), 1) AS f FROM x, cut),
s AS (SELECT list(llr ORDER BY llr) AS v, count(*) AS n FROM x), p AS (SELECT v, f, f * (n - 1) AS q FROM s, f)
SELECT 'm' AS mod_base, round(f, 6) AS frac_mod, round(v[floor(q)::BIGINT + 1] + (q - floor(q)) * (v[least(floor(q)::BIGINT + 2, len(v))] - v[floor(q)::BIGINT + 1]), 6) AS threshold FROM p""")
def mods_estimated_threshold(spark, d):
    out = mods.global_threshold(mods.site_llrs(fx.mod_calls(spark, d), ALPHABET), "m")
    return out.select("mod_base", r6("frac_mod").alias("frac_mod"), r6("threshold").alias("threshold"))


@query(f"""WITH {o.LLRS},
truth AS (SELECT 'chr' || (l_partkey % 5) AS chrm, l_partkey AS pos, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS strand, count(*) AS cov, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS mod_cov FROM lineitem GROUP BY ALL),
per AS (SELECT chrm, pos, strand, list(llr ORDER BY llr) AS v, count(*) AS reads FROM llrs WHERE mod_base = 'm' GROUP BY ALL),
j AS (SELECT t.*, coalesce(reads, 0) AS reads, v, mod_cov / cov AS share FROM truth t LEFT JOIN per USING (chrm, pos, strand)),
s AS (SELECT *, CASE WHEN cov < 10 THEN 'low_truth' WHEN reads < 12 THEN 'low_reads' ELSE 'ok' END AS status, share * (reads - 1) AS q FROM j)
SELECT chrm, pos, strand, reads, cov AS truth_cov, round(100 * share, 6) AS pct,
       round(CASE WHEN status = 'ok' THEN CASE WHEN share <= 0 THEN -100.0 WHEN share >= 1 THEN 100.0
         ELSE v[floor(q)::BIGINT + 1] + (q - floor(q)) * (v[least(floor(q)::BIGINT + 2, len(v))] - v[floor(q)::BIGINT + 1]) END END, 6) AS threshold, status
FROM s""")
def mods_per_site_thresholds(spark, d):
    truth = fx.bed_methyl(spark, d).groupBy(F.col("chrom").alias("chrm"), "pos", "strand").agg(F.sum("cov").alias("cov"), F.sum("mod_cov").alias("mod_cov"))
    out = mods.per_site_thresholds(mods.site_llrs(fx.mod_calls(spark, d), ALPHABET), truth, "m", least_truth=10, least_reads=12)
    return out.withColumn("pct", r6("pct")).withColumn("threshold", r6("threshold"))


@query(f"""WITH {o.MOD_CALLS}, lens AS (SELECT chrm, max(pos) + 1 AS chrm_len FROM calls GROUP BY chrm),
off AS (SELECT chrm, coalesce(sum(2 * chrm_len) OVER (ORDER BY chrm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM lens)
SELECT chrm, pos, strand, o + 2 * pos + CASE WHEN strand = -1 THEN 1 ELSE 0 END AS pos_id, count(*) AS n
FROM calls JOIN off USING (chrm) WHERE chrm = 'chr3' AND pos >= 100 AND pos < 900 GROUP BY ALL""")
def mods_position_range(spark, d):
    calls = fx.mod_calls(spark, d)
    contigs = calls.groupBy("chrm").agg((F.max("pos") + 1).alias("chrm_len"))
    coded = mods.encode_positions(mods.position_range(calls, "chr3", 100, 900), mods.contig_offsets(contigs))
    return coded.groupBy(*fx.SITE, "pos_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {o.MOD_CALLS} SELECT chrm, pos, strand, count(*) AS rows_kept, count(DISTINCT read_id) AS reads FROM calls
WHERE read_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def mods_read_filter(spark, d):
    keep = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("read_id"))
    calls = fx.mod_calls(spark, d).join(keep, "read_id", "left_semi")
    return calls.groupBy(*fx.SITE).agg(F.count(F.lit(1)).alias("rows_kept"), F.countDistinct("read_id").alias("reads"))


@query(f"""WITH {o.MOD_CALLS} SELECT count(DISTINCT chrm) AS contigs, count(DISTINCT (chrm, pos, strand)) AS sites, count(DISTINCT read_id) AS reads, count(DISTINCT mod_base) AS mods, count(*) AS n FROM calls""")
def mods_counts(spark, d):
    c = fx.mod_calls(spark, d)
    return c.agg(F.countDistinct("chrm").alias("contigs"), F.countDistinct(*fx.SITE).alias("sites"), F.countDistinct("read_id").alias("reads"), F.countDistinct("mod_base").alias("mods"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {o.MOD_CALLS}, can AS (SELECT chrm, pos, strand, read_id, round(ln(1 - sum(exp(score))), 5) AS can_lp FROM calls GROUP BY ALL)
SELECT 'Order#' || read_id AS uuid, chrm, pos, CASE strand WHEN 1 THEN '+' ELSE '-' END AS strand, score AS mod_log_prob, can_lp AS can_log_prob,
       CASE mod_base WHEN 'h' THEN '5hmC' ELSE '5mC' END AS mod_base FROM calls JOIN can USING (chrm, pos, strand, read_id)""")
def mods_per_read_text(spark, d):
    from strandlake.sources import text

    calls = fx.mod_calls(spark, d)
    reads = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("uuid"))
    names = spark.createDataFrame([("h", "5hmC"), ("m", "5mC")], "mod_base string, mod_long_name string")
    return text.per_read_mods(calls, reads, names).withColumn("can_log_prob", F.round("can_log_prob", 5))


# --- D: variants ----------------------------------------------------------


@query(f"""WITH {o.VAR_CALLS}, ref AS (SELECT locus, read_id, ln(1 - sum(exp(score))) AS score FROM calls GROUP BY ALL),
s AS (SELECT locus, '0' AS a, sum(score) AS lp, count(*) AS reads FROM ref GROUP BY ALL UNION ALL SELECT locus, alt_seq, sum(score), count(*) FROM calls GROUP BY ALL),
z AS (SELECT locus, max(reads) AS reads, max(lp) AS top FROM s GROUP BY locus),
n AS (SELECT locus, z.reads, top + ln(sum(exp(lp - top))) AS z, max(CASE WHEN a = '0' THEN lp END) AS l0, max(CASE WHEN a = 'A' THEN lp END) AS l1, max(CASE WHEN a = 'T' THEN lp END) AS l2 FROM s JOIN z USING (locus) GROUP BY locus, z.reads, top)
SELECT locus, reads, round(l0 - z, 4) AS lp_ref, round(l1 - z, 4) AS lp_a, round(l2 - z, 4) AS lp_t, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS gt FROM n""")
def variants_haploid(spark, d):
    out = variants.haploid(fx.var_calls(spark, d))
    lp = lambda i: F.round(F.get("log_probs", F.lit(i)), 4)
    return out.select("locus", "reads", lp(0).alias("lp_ref"), lp(1).alias("lp_a"), lp(2).alias("lp_t"), "gt")


@query(f"""WITH {o.DIPLOID}
SELECT locus, reads, gt, round(lp00, 4) AS lp00, round(lp01, 4) AS lp01, round(lp11, 4) AS lp11, round(lp02, 4) AS lp02, round(lp12, 4) AS lp12, round(lp22, 4) AS lp22 FROM wide""")
def variants_diploid(spark, d):
    out = variants.diploid(fx.var_calls(spark, d))
    names = ["lp00", "lp01", "lp11", "lp02", "lp12", "lp22"]
    return out.select("locus", "reads", "gt", *[F.round(F.get("log_probs", F.lit(i)), 4).alias(n) for i, n in enumerate(names)])


_FACTORS = o.DIPLOID.replace("sum(score) AS lp, count(*) AS n FROM sc", "sum(score) + count(*) * ln(max(CASE WHEN locus % 3 = 0 THEN 0.78::DOUBLE ELSE 0.85::DOUBLE END)) AS lp, count(*) AS n FROM sc")


@query(f"""WITH {_FACTORS}
SELECT locus, reads, gt, round(lp00, 4) AS lp00, round(lp01, 4) AS lp01, round(lp11, 4) AS lp11, round(lp02, 4) AS lp02, round(lp12, 4) AS lp12, round(lp22, 4) AS lp22 FROM wide""")
def variants_two_factors(spark, d):
    """Every third locus replaces two bases, so that the factor of longer changes holds there."""
    calls = fx.var_calls(spark, d).withColumn("ref_seq", F.when(F.col("locus") % 3 == 0, "CG").otherwise("C"))
    out = variants.diploid(calls, (0.85, 0.78))
    names = ["lp00", "lp01", "lp11", "lp02", "lp12", "lp22"]
    return out.select("locus", "reads", "gt", *[F.round(F.get("log_probs", F.lit(i)), 4).alias(n) for i, n in enumerate(names)])


_ONE_ALT = o.DIPLOID.replace("AS score FROM vw\n          UNION ALL SELECT locus, read_id, 'T', round(ln(greatest(5 * t, 1e-6)), 6) FROM vw", "AS score FROM vw")
_BREAKS = f"""{_ONE_ALT}, b AS (SELECT locus, CASE locus % 3 WHEN 0 THEN 'SNP' WHEN 1 THEN 'DEL' ELSE 'INS' END AS kind, CASE (locus * 7 % 11) % 3 WHEN 0 THEN 'hom_ref' WHEN 1 THEN 'het' ELSE 'hom_alt' END AS truth,
    CASE WHEN lp00 >= lp11 THEN 'hom_ref' ELSE 'hom_alt' END AS hom, (lp01 - greatest(lp00, lp11)) / reads AS pt FROM wide)"""


@query(f"""WITH {_BREAKS}, r AS (SELECT kind, truth, hom, round(pt, 4) AS pt FROM b),
p AS (SELECT DISTINCT kind, pt FROM r UNION SELECT DISTINCT kind, '-inf'::DOUBLE FROM r),
n AS (SELECT p.kind, p.pt, r.truth, CASE WHEN r.pt <= p.pt THEN r.hom ELSE 'het' END AS call FROM p JOIN r ON p.kind = r.kind),
f AS (SELECT kind, pt, c, 2.0 * count(*) FILTER (truth = c AND call = c) / (count(*) FILTER (truth = c) + count(*) FILTER (call = c)) AS f1, count(*) FILTER (truth = c AND call = c) AS hit FROM n, (VALUES ('hom_ref'), ('het'), ('hom_alt')) t(c) GROUP BY ALL)
SELECT kind, round(CASE WHEN pt = '-inf'::DOUBLE THEN 0 ELSE exp(pt) END, 6) AS factor, round(max(CASE WHEN c = 'hom_ref' AND hit > 0 THEN f1 END), 6) AS f1_hom_ref, round(max(CASE WHEN c = 'het' AND hit > 0 THEN f1 END), 6) AS f1_het,
  round(max(CASE WHEN c = 'hom_alt' AND hit > 0 THEN f1 END), 6) AS f1_hom_alt, round(avg(CASE WHEN hit > 0 THEN f1 END), 6) AS mean_f1 FROM f GROUP BY kind, pt""")
def variants_factor_sweep(spark, d):
    calls = variants.diploid(fx.var_calls(spark, d).where("alt_seq = 'A'"))
    k = F.col("p_partkey")
    state = ((k * 7) % 11) % 3
    truth = read_table(spark, d, "part").select(k.alias("locus"), F.when(k % 3 == 0, "SNP").when(k % 3 == 1, "DEL").otherwise("INS").alias("kind"), F.when(state == 0, "hom_ref").when(state == 1, "het").otherwise("hom_alt").alias("truth"))
    out = variants.factor_sweep(variants.factor_breaks(calls, truth), 4)
    return out.select("kind", *[r6(c).alias(c) for c in ("factor", "f1_hom_ref", "f1_het", "f1_hom_alt", "mean_f1")])


@query(f"""WITH {o.DIPLOID}, gl AS (SELECT locus, gt, list_transform([lp00, lp01, lp11, lp02, lp12, lp22], lambda x: greatest(round(x, 4) / ln(10), -999)) AS gl FROM wide),
raw AS (SELECT locus, gt, gl, list_transform(gl, lambda x: round_even(-10 * x, 0)) AS raw FROM gl),
pl AS (SELECT locus, gt, gl, list_transform(raw, lambda x: least(x - list_min(raw), 999)::INTEGER) AS pl FROM raw)
SELECT locus, gt, array_to_string(list_transform(gl, lambda x: printf('%.2f', round_even(x * 100, 0) / 100 + 0.0)), ',') AS gl, array_to_string(pl, ',') AS pl, list_sort(pl)[2] AS gq, CASE WHEN round_even(abs(-10 * gl[1]), 0) > 0 THEN round_even(abs(-10 * gl[1]), 0)::INTEGER END AS qual FROM pl""")
def variants_vcf_fields(spark, d):
    out = variants.diploid(fx.var_calls(spark, d)).withColumn("log_probs", F.transform("log_probs", lambda x: F.round(x, 4)))
    f = expr.genotype_fields(F.col("log_probs"))
    two = F.array_join(F.transform(f["gl"], lambda x: F.format_string("%.2f", expr.round_half_even(x, 2) + 0.0)), ",")
    return out.select("locus", "gt", two.alias("gl"), F.array_join(f["pl"], ",").alias("pl"), f["gq"].alias("gq"), f["qual"].alias("qual"))


@query(f"""WITH {o.VAR_CALLS}, ref AS (SELECT locus, read_id, round(ln(1 - sum(exp(score))), 5) AS ref_log_prob FROM calls GROUP BY ALL)
SELECT 'Order#' || read_id AS uuid, locus AS pos, 'C' AS ref_seq, alt_seq, score AS alt_log_prob, ref_log_prob FROM calls JOIN ref USING (locus, read_id)""")
def variants_per_read_text(spark, d):
    from strandlake.sources import text

    calls = fx.var_calls(spark, d)
    reads = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("uuid"))
    loci = read_table(spark, d, "part").select(F.col("p_partkey").alias("locus"), F.col("p_partkey").alias("pos"), F.lit("C").alias("ref_seq"))
    return text.per_read_variants(calls, reads, loci).withColumn("ref_log_prob", F.round("ref_log_prob", 5))


@query(f"""WITH {o.VAR_CALLS}, ref AS (SELECT locus, read_id, round(ln(1 - sum(exp(score))), 5) AS ref_log_prob FROM calls GROUP BY ALL)
SELECT 'Order#' || read_id AS uuid, 'chr' || (locus % 5) AS chrm, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, locus AS pos, 'C' AS ref_seq, alt_seq, score AS alt_log_prob, ref_log_prob
FROM calls JOIN ref USING (locus, read_id) JOIN orders ON o_orderkey = read_id""")
def variants_per_read_strands(spark, d):
    from strandlake.sources import text

    reads = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("uuid"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("strand"))
    k = F.col("p_partkey")
    loci = read_table(spark, d, "part").select(k.alias("locus"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chrm"), k.alias("pos"), F.lit("C").alias("ref_seq"))
    return text.per_read_variants(fx.var_calls(spark, d), reads, loci).withColumn("ref_log_prob", F.round("ref_log_prob", 5))


@query("""WITH v AS (SELECT p_partkey % 5 AS contig, p_partkey AS pos, p_partkey AS id, substr('ACGTACGT', 1 + p_partkey % 4, 3) AS ref, substr('TGCATGCA', 1 + p_size % 4, 3) AS alt FROM part),
b AS (SELECT contig, pos + k - 1 AS pos, substr(ref, k, 1) AS ref, substr(alt, k, 1) AS alt, id FROM v, (VALUES (1), (2), (3)) t(k))
SELECT contig, pos, ref, alt, string_agg(DISTINCT id::VARCHAR, ';' ORDER BY id::VARCHAR) AS ids FROM b WHERE ref <> alt GROUP BY ALL""")
def variants_atomize(spark, d):
    p = read_table(spark, d, "part")
    k = F.col("p_partkey")
    v = p.select((k % 5).alias("contig"), k.alias("pos"), k.alias("id"), F.substring(F.lit("ACGTACGT"), (1 + k % 4).cast("int"), F.lit(3)).alias("ref"), F.array(F.substring(F.lit("TGCATGCA"), 1 + F.col("p_size") % 4, F.lit(3))).alias("alts"))
    return variants.atomize(v)


@query("""WITH t AS (SELECT o_orderkey % 5 AS contig, o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' ELSE 'A' END AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'A' ELSE 'AT' END AS alt,
  CASE o_orderstatus WHEN 'F' THEN 'hom_ref' WHEN 'O' THEN 'het' ELSE 'hom_alt' END AS truth, CASE o_custkey % 4 WHEN 0 THEN 'hom_ref' WHEN 1 THEN 'hom_alt' ELSE 'het' END AS call FROM orders)
SELECT CASE WHEN length(ref) = length(alt) THEN 'SNP' WHEN length(ref) > length(alt) THEN 'DEL' ELSE 'INS' END AS kind, truth, call, count(*) AS n FROM t GROUP BY ALL""")
def variants_confusion(spark, d):
    x = read_table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    base = x.select((F.col("o_orderkey") % 5).alias("contig"), F.col("o_orderkey").alias("pos"), F.when(k == 1, "AC").otherwise("A").alias("ref"), F.when(k == 0, "G").when(k == 1, "A").otherwise("AT").alias("alt"),
                    F.when(F.col("o_orderstatus") == "F", "0/0").when(F.col("o_orderstatus") == "O", "0/1").otherwise("1/1").alias("t"), F.when(F.col("o_custkey") % 4 == 0, "0/0").when(F.col("o_custkey") % 4 == 1, "1/1").otherwise("1/0").alias("c"))
    return variants.split_genotype_counts(base.withColumnRenamed("c", "gt"), base.withColumnRenamed("t", "gt"))


@query("""WITH t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'SNP' WHEN 1 THEN 'DEL' ELSE 'INS' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'hom_ref' WHEN 'O' THEN 'het' ELSE 'hom_alt' END AS truth, CASE o_custkey % 4 WHEN 0 THEN 'hom_ref' WHEN 1 THEN 'hom_alt' ELSE 'het' END AS call FROM orders),
c AS (SELECT kind, class, sum((truth = class AND call = class)::INT) AS hit, sum((call = class)::INT) AS called, sum((truth = class)::INT) AS true_n FROM t, (VALUES ('hom_ref'), ('het'), ('hom_alt')) v(class) GROUP BY ALL)
SELECT kind, class, round(hit / called, 6) AS precision, round(hit / true_n, 6) AS recall, round(2 * (hit / called) * (hit / true_n) / (hit / called + hit / true_n), 6) AS f1 FROM c""")
def variants_confusion_scores(spark, d):
    s = variants.confusion_scores(variants_confusion(spark, d))
    return s.select("kind", "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# --- D: site tables -------------------------------------------------------


@query(f"""WITH {o.BED} SELECT chrom, CAST(NULL AS INTEGER) AS strand, CASE WHEN strand = -1 THEN pos - 1 ELSE pos END AS pos, sum(cov)::BIGINT AS cov, sum(round_even(pct * cov / 100, 0)::BIGINT)::BIGINT AS mod_cov FROM bed GROUP BY ALL""")
def sites_sum_strands(spark, d):
    return sites.sum_records(fx.bed_methyl(spark, d), strand_offset=1)


@query(f"""WITH {o.BED}, s AS (SELECT chrom, strand, pos, sum(cov)::BIGINT AS cov, sum(round_even(pct * cov / 100, 0)::BIGINT)::BIGINT AS mod_cov FROM bed GROUP BY ALL)
SELECT *, round_even(1000.0 * mod_cov / cov, 0) / 10 AS pct FROM s""")
def sites_merge(spark, d):
    b = fx.bed_methyl(spark, d)
    return sites.merge([b.where(F.col("sample") == s) for s in ("A", "N", "R")])


@query(f"""WITH {o.BED}, s AS (SELECT chrom, strand, pos, sum(cov) AS cov, sum(round_even(pct * cov / 100, 0)) AS m FROM bed GROUP BY ALL)
SELECT chrom, strand, pos, CASE WHEN 100.0 * m / cov <= 10 THEN false ELSE true END AS is_mod FROM s WHERE cov >= 3 AND (100.0 * m / cov <= 10 OR 100.0 * m / cov >= 90)""")
def sites_ground_truth(spark, d):
    return sites.ground_truth(sites.sum_records(fx.bed_methyl(spark, d)), least=3)


@query(f"""WITH {o.BED} SELECT sample, count(*) AS sites, median(cov) AS median_cov, round(avg(cov), 6) AS mean_cov, round(stddev_pop(cov), 6) AS sd_cov FROM bed GROUP BY sample""")
def sites_coverage_stats(spark, d):
    s = sites.coverage_stats(fx.bed_methyl(spark, d), ["sample"])
    return s.select("sample", "sites", F.col("median_cov").cast("double").alias("median_cov"), r6("mean_cov").alias("mean_cov"), r6("sd_cov").alias("sd_cov"))


@query(f"""WITH {o.PAIRED} SELECT count(*) AS sites, round(corr(pct_a, pct_b), 6) AS r, round(corr(pct_a, pct_b) ** 2, 6) AS r2, round(sqrt(avg((pct_a - pct_b) ** 2)), 6) AS rmse FROM pairs""")
def sites_compare(spark, d):
    return sites.comparison(_pairs(spark, d)).select("sites", *[r6(c).alias(c) for c in ("r", "r2", "rmse")])


@query(f"""WITH {o.PAIRED} SELECT least(floor(pct_a * 31 / 100.0), 30)::INTEGER AS bin_a, least(floor(pct_b * 31 / 100.0), 30)::INTEGER AS bin_b, count(*) AS n FROM pairs GROUP BY ALL""")
def sites_histogram_2d(spark, d):
    return sites.histogram_2d(_pairs(spark, d))


def _pairs(spark, d):
    b = fx.bed_methyl(spark, d)
    return sites.paired(b.where("sample = 'A'"), b.where("sample = 'N'"), 2)


@query(f"""WITH {o.BED}, h AS (SELECT cov, count(*) AS n FROM bed GROUP BY cov), c AS (SELECT cov, n, sum(n) OVER (ORDER BY cov) AS upto, sum(n) OVER () AS all_n FROM h)
SELECT cov, n FROM c WHERE upto > 0.01 * all_n AND upto - n < 0.99 * all_n""")
def sites_coverage_histogram(spark, d):
    return sites.coverage_histogram(fx.bed_methyl(spark, d))


@query(f"""WITH {o.SEQS} SELECT 'doc' || name AS chrom, p AS pos, 1 AS strand FROM seqs, unnest(range(0, length(seq) - 1)) t(p) WHERE substr(seq, p + 1, 2) = 'CG'
UNION ALL SELECT 'doc' || name, p + 1, -1 FROM seqs, unnest(range(0, length(seq) - 1)) t(p) WHERE substr(seq, p + 1, 2) = 'CG'""")
def sites_motif_bed(spark, d):
    return sites.motif_sites(_contigs(spark, d), "CG", 0)


def _contigs(spark, d):
    return fx.sequences(spark, d).select(F.concat(F.lit("doc"), F.col("name").cast("string")).alias("chrom"), "seq")


@query(f"""WITH {o.SEQS}, s AS (SELECT 'doc' || name AS chrom, seq, p AS pos FROM seqs, unnest(range(0, length(seq))) t(p) WHERE substr(seq, p + 1, 1) = 'C')
SELECT chrom, pos, 1 AS strand, CASE WHEN substr(seq, pos + 1, 2) = 'CG' THEN 'CG' WHEN length(substr(seq, pos + 1, 3)) = 3 AND substr(seq, pos + 2, 1) IN ('A', 'C', 'T') AND substr(seq, pos + 3, 1) = 'G' THEN 'CHG' WHEN length(substr(seq, pos + 1, 3)) = 3 AND substr(seq, pos + 2, 1) IN ('A', 'C', 'T') AND substr(seq, pos + 3, 1) IN ('A', 'C', 'T') THEN 'CHH' END AS motif FROM s""")
def sites_split_by_motif(spark, d):
    c = _contigs(spark, d)
    every_c = sites.motif_sites(c, "C", 0).where("strand = 1")
    return sites.split_by_motif(every_c, c, [("CG", 0), ("CHG", 0), ("CHH", 0)])


@query(f"""WITH {o.BED} SELECT chrom, pos, strand, cov, sample FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, strand ORDER BY sample) AS rn FROM bed) WHERE rn = 1""")
def sites_first_listed(spark, d):
    b = fx.bed_methyl(spark, d).withColumn("key", F.concat_ws(":", "chrom", "pos", "strand"))
    out = sites.first_listed([b.where(F.col("sample") == s) for s in ("A", "N", "R")], "key")
    return out.select("chrom", "pos", "strand", "cov", "sample")


@query(f"""WITH {o.MOD_CALLS}, a AS (SELECT *, 'Order#' || read_id AS uuid FROM calls)
SELECT chrm, pos, strand, uuid, mod_base, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * REPLACE (round(score - 0.5, 6) AS score) FROM a WHERE pos % 2 = 0) GROUP BY ALL""")
def sites_merge_per_read(spark, d):
    a = fx.mod_calls(spark, d).select(*fx.SITE, F.concat(F.lit("Order#"), F.col("read_id").cast("string")).alias("uuid"), "mod_base", "score")
    b = a.where("pos % 2 = 0").withColumn("score", F.round(F.col("score") - 0.5, 6))
    return sites.merge_per_read([a, b], fx.SITE)


@query(f"""WITH {o.BED}, a AS (SELECT DISTINCT chrom, pos, strand FROM bed WHERE sample = 'A'), n AS (SELECT DISTINCT chrom, pos, strand FROM bed WHERE sample = 'N')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM n) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM n)""")
def sites_set_operations(spark, d):
    key = ["chrom", "pos", "strand"]
    b = fx.bed_methyl(spark, d)
    x, y = b.where("sample = 'A'").select(*key), b.where("sample = 'N'").select(*key)
    both = x.intersect(y).agg(F.lit("both").alias("part"), F.count(F.lit(1)).alias("n"))
    return both.unionByName(x.subtract(y).agg(F.lit("only_a").alias("part"), F.count(F.lit(1)).alias("n")))


# --- E, F: intervals ------------------------------------------------------


@query(f"""WITH {o.INTERVALS} SELECT read_id, iv.contig, r_st, r_en, pos FROM iv JOIN st ON iv.contig = st.contig AND pos >= r_st AND pos < r_en""")
def intervals_reads_sites(spark, d):
    iv, st = fx.read_intervals(spark, d), fx.interval_sites(spark, d)
    return intervals.points_in_intervals(iv.drop("strand"), st.drop("strand"), ["contig"], "r_st", "r_en", "pos")


@query(f"""WITH {o.INTERVALS} SELECT * FROM iv WHERE NOT EXISTS (SELECT 1 FROM st WHERE iv.contig = st.contig AND iv.strand = st.strand AND pos >= r_st AND pos < r_en)""")
def intervals_reads_without_sites(spark, d):
    return intervals.points_in_intervals(fx.read_intervals(spark, d), fx.interval_sites(spark, d), ["contig", "strand"], "r_st", "r_en", "pos", how="left_anti")


@query(f"""WITH {o.INTERVALS}, r AS (SELECT contig, pos FROM st)
SELECT read_id, iv.contig, pos FROM iv JOIN r ON iv.contig = r.contig WHERE pos >= r_st AND pos < r_en AND pos - r_st > 5 AND r_en - pos > 5""")
def intervals_edge_buffer(spark, d):
    iv = fx.read_intervals(spark, d).drop("strand")
    calls = intervals.points_in_intervals(iv, fx.interval_sites(spark, d).drop("strand"), ["contig"], "r_st", "r_en", "pos").select("read_id", "contig", "pos")
    return mods.edge_buffer(calls, iv, 5)


@query(f"""WITH {o.SPANS} SELECT a.contig, a.id, b.id AS b_id FROM sp a JOIN sp b ON a.contig = b.contig AND b.start >= a."end" AND b.start - a."end" <= 5""")
def intervals_context_variants(spark, d):
    v = fx.variant_spans(spark, d)
    return intervals.band_pairs(v, ["contig"], "start", "end", 5, "id").select("contig", "id", "b_id")


@query(f"""WITH {o.SPANS}, r AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT contig, island::BIGINT AS island, arg_max(id, (qual, -id)) AS id, max(qual) AS qual, count(*) AS members FROM i GROUP BY ALL""")
def intervals_best_of_islands(spark, d):
    return intervals.best_of_islands(fx.variant_spans(spark, d), ["contig"], "qual", "id")


@query(f"""WITH RECURSIVE {o.SPANS}, y AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY start, "end", id) AS n FROM sp),
fold AS (SELECT contig, n, start, "end", id, qual, true AS fresh FROM y WHERE n = 1
  UNION ALL SELECT y.contig, y.n, CASE WHEN y.start >= f."end" OR y.qual > f.qual THEN y.start ELSE f.start END, CASE WHEN y.start >= f."end" OR y.qual > f.qual THEN y."end" ELSE f."end" END,
    CASE WHEN y.start >= f."end" OR y.qual > f.qual THEN y.id ELSE f.id END, CASE WHEN y.start >= f."end" OR y.qual > f.qual THEN y.qual ELSE f.qual END, y.start >= f."end"
  FROM fold f JOIN y ON y.contig = f.contig AND y.n = f.n + 1)
SELECT contig, start, "end", id, qual FROM (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY contig ORDER BY n), true) AS last FROM fold) WHERE last""")
def intervals_resolve_overlaps(spark, d):
    return intervals.resolve_overlaps(fx.variant_spans(spark, d), ["contig"], "qual", "id")


@query(f"""WITH {o.SPANS}, f AS (SELECT * FROM sp WHERE id % 2 = 0), r AS (SELECT * FROM sp WHERE id % 2 = 1)
SELECT f.contig, f.id, r.id AS b_id FROM f JOIN r ON f.contig = r.contig AND f.start < r."end" AND r.start < f."end" """)
def intervals_strand_overlaps(spark, d):
    v = fx.variant_spans(spark, d)
    return intervals.overlaps(v.where("id % 2 = 0"), v.where("id % 2 = 1"), ["contig"]).select("contig", "id", "b_id")


@query(f"""WITH {o.SPANS}, f AS (SELECT * FROM sp WHERE id % 2 = 0), r AS (SELECT * FROM sp WHERE id % 7 = 1)
SELECT contig, id, 'forward_only' AS side FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE f.contig = r.contig AND f.start < r."end" AND r.start < f."end")
UNION ALL SELECT contig, id, 'reverse_only' FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.contig = r.contig AND f.start < r."end" AND r.start < f."end")""")
def intervals_strand_leftovers(spark, d):
    v = fx.variant_spans(spark, d)
    f, r = v.where("id % 2 = 0"), v.where("id % 7 = 1")
    hits = intervals.overlaps(f, r, ["contig"])
    a = f.join(hits.select("contig", "id"), ["contig", "id"], "left_anti").select("contig", "id", F.lit("forward_only").alias("side"))
    b = r.join(hits.select("contig", F.col("b_id").alias("id")), ["contig", "id"], "left_anti").select("contig", "id", F.lit("reverse_only").alias("side"))
    return a.unionByName(b)


@query("""WITH r AS (SELECT o_orderkey AS read_id, 20 + o_custkey % 80 AS n FROM orders), p AS (SELECT read_id, k * 5 AS pos FROM r, unnest(range(0, (n + 4) // 5)) t(k) WHERE k < 400)
SELECT read_id, pos, kind, size FROM p, (VALUES ('snp', 1), ('del', 1), ('del', 2), ('del', 3), ('del', 4), ('del', 5), ('ins', 1), ('ins', 2), ('ins', 3), ('ins', 4), ('ins', 5)) v(kind, size)""")
def reads_candidate_positions(spark, d):
    from strandlake.operators import reads

    r = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), (20 + F.col("o_custkey") % 80).alias("n"))
    return reads.candidate_changes(r)


@query("""SELECT min(read_id) AS read_id, uuid, count(*) AS copies FROM (SELECT o_orderkey AS read_id, o_custkey % 500 AS uuid FROM orders) WHERE uuid % 3 <> 0 GROUP BY uuid""")
def reads_enumerate(spark, d):
    from strandlake.operators import reads

    r = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 500).alias("uuid"))
    allow = r.select("uuid").where("uuid % 3 <> 0").distinct()
    return reads.enumerate_reads(r, allow)


@query("""WITH a AS (SELECT o_orderkey AS read_id, 20 + o_custkey % 80 AS m, o_custkey % 5 AS i, o_custkey % 7 AS dl, o_custkey % 11 AS s FROM orders),
x AS (SELECT read_id, m + i + dl AS num_align, m AS num_match, dl AS num_del, i AS num_ins, 100.0 * m / (m + i + dl) AS pct_identity, 100.0 * (m + i) / (m + i + s) AS cov FROM a)
SELECT read_id, num_align, num_match, num_del, num_ins, round(pct_identity, 6) AS pct_identity, round(cov, 6) AS read_pct_coverage FROM x WHERE pct_identity >= 90 AND cov >= 95""")
def reads_alignment_summary(spark, d):
    from strandlake.operators import reads

    k = F.col("o_custkey")
    parts = [((20 + k % 80), "M"), (k % 5, "I"), (k % 7, "D"), (k % 11, "S")]
    cigar = F.concat(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise(F.lit("")) for n, op in parts])
    a = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), cigar.alias("cigar"))
    s = reads.passing(reads.alignment_summary(a), min_identity=90, min_coverage=95)
    return s.select("read_id", *[F.col(c).cast("long").alias(c) for c in ("num_align", "num_match", "num_del", "num_ins")], r6("pct_identity").alias("pct_identity"), r6("read_pct_coverage").alias("read_pct_coverage"))


# --- D: validation --------------------------------------------------------

_LABELLED = "l AS (SELECT doc_id, quality AS label, n_chars::DOUBLE AS score, lang FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    return read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


@query(f"""WITH {_LABELLED}, s AS (SELECT lang, score, sum(label) AS dp, sum(1 - label) AS dn FROM l GROUP BY ALL),
c AS (SELECT lang, score, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY lang) AS p, sum(dn) OVER (PARTITION BY lang) AS n FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, score, round(tp / (tp + fp), 6) AS precision, round(CASE WHEN p > 0 THEN tp / p END, 6) AS recall, round(CASE WHEN n > 0 THEN fp / n END, 6) AS fpr,
       round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) END, 6) AS f1 FROM c""")
def validate_curve(spark, d):
    c = validate.curve(_labelled(spark, d), ["lang"])
    return c.select("lang", "score", *[r6(x).alias(x) for x in ("precision", "recall", "fpr", "f1")])


@query(f"""WITH {_LABELLED}, s AS (SELECT lang, score, sum(label) AS dp, sum(1 - label) AS dn FROM l GROUP BY ALL),
c AS (SELECT lang, score, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp, sum(dp) OVER (PARTITION BY lang) AS p, sum(dn) OVER (PARTITION BY lang) AS n FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, tp / (tp + fp) AS precision, tp / p AS recall, fp / n AS fpr FROM c),
q AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(fpr) OVER w, 0) AS f0 FROM m WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, round(sum((recall - r0) * precision), 6) AS ap, round(sum((fpr - f0) * (recall + r0) / 2), 6) AS auc, round(max(f1), 6) AS best_f1, arg_max(score, (f1, score)) AS best_threshold FROM q GROUP BY lang""")
def validate_summary(spark, d):
    s = validate.summary(_labelled(spark, d), ["lang"])
    return s.select("lang", "positives", "negatives", *[r6(x).alias(x) for x in ("ap", "auc", "best_f1")], "best_threshold")


@query("""WITH r AS (SELECT o_orderstatus AS sample, 20 + o_custkey % 80 AS m, o_custkey % 5 + o_custkey % 7 AS e FROM orders), x AS (SELECT *, 100.0 * m / (m + e) AS acc FROM r),
c AS (SELECT sample, round_even(acc * 10, 0) / 10 AS a, count(*) AS n FROM x GROUP BY ALL), md AS (SELECT sample, arg_max(a, (n, -a)) AS mode_acc FROM c GROUP BY sample)
SELECT sample, count(*) AS reads, round(median(acc), 6) AS median_acc, round(avg(acc), 6) AS mean_acc, round(100.0 * sum(m) / sum(m + e), 6) AS parsimonious_acc, sum(m + e)::BIGINT AS aligned, any_value(mode_acc) AS mode_acc FROM x JOIN md USING (sample) GROUP BY sample""")
def validate_accuracy(spark, d):
    k = F.col("o_custkey")
    m, e = 20 + k % 80, k % 5 + k % 7
    r = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("sample"), m.alias("num_match"), (m + e).alias("num_align"), (100.0 * m / (m + e)).alias("pct_identity"))
    s = validate.accuracy_summary(r, ["sample"])
    return s.select("sample", "reads", *[r6(x).alias(x) for x in ("median_acc", "mean_acc", "parsimonious_acc")], "aligned", "mode_acc")


@query("""SELECT event_type || ' at ' || (user_id % 10) AS message, count(*) AS n, round(100.0 * count(*) / 1000, 6) AS pct FROM events GROUP BY 1 ORDER BY n DESC, message LIMIT 7""")
def validate_common_errors(spark, d):
    e = read_table(spark, d, "events").select(F.concat("event_type", F.lit(" at "), (F.col("user_id") % 10).cast("string")).alias("message"))
    return validate.most_common_errors(e, 7, 1000).withColumn("pct", r6("pct"))


@query(f"""WITH {_LABELLED}, n AS (SELECT lang, min(c) AS least FROM (SELECT lang, label, count(*) AS c FROM l GROUP BY ALL) GROUP BY lang)
SELECT lang, v.label, least AS n FROM n, (VALUES (0), (1)) v(label) WHERE (lang, v.label) IN (SELECT lang, label FROM l)""")
def validate_balanced_counts(spark, d):
    b = validate.balanced(_labelled(spark, d), ["lang"], "label", "doc_id")
    return b.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


# --- calibration ----------------------------------------------------------


def _stats(spark, d):
    """Scores of known truth: mod_base, is_mod, llr."""
    s = mods.site_llrs(fx.mod_calls(spark, d), ALPHABET)
    return s.select("mod_base", (F.col("strand") == 1).alias("is_mod"), F.round("llr", 2).alias("llr"))


@query(f"""WITH {o.LLRS}, s AS (SELECT mod_base, strand = 1 AS is_mod, round(llr, 2) AS llr FROM llrs), c AS (SELECT mod_base, is_mod, llr, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT mod_base, is_mod, sum(n) AS total FROM c GROUP BY ALL)
SELECT mod_base, is_mod, i::INTEGER AS i, round(sum(n * exp(-power((-20 + i * 0.8 - llr) / 0.8, 2) / 2)) / (0.8 * sqrt(2 * pi())) / any_value(total), 6) AS density
FROM c JOIN t USING (mod_base, is_mod), range(0, 51) g(i) GROUP BY ALL""")
def calibrate_density(spark, d):
    out = calibrate.exact_densities(_stats(spark, d), ["mod_base", "is_mod"], -20.0, 20.0, 51)
    return out.withColumn("density", r6("density"))


@query(f"""WITH {o.LLRS}, s AS (SELECT mod_base, strand = 1 AS is_mod, round(llr, 2) AS llr FROM llrs),
c AS (SELECT mod_base, is_mod, round_even(llr / 0.008::DOUBLE, 0) * 0.008::DOUBLE AS centre, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT mod_base, is_mod, sum(n) AS total FROM c GROUP BY ALL)
SELECT mod_base, is_mod, i, round(sum(n * exp(-power((-20 + i * 0.8::DOUBLE - centre) / 0.8::DOUBLE, 2) / 2)) / (0.8 * sqrt(2 * pi())) / any_value(total), 6) AS density
FROM c JOIN t USING (mod_base, is_mod), range(0, 51) g(i) WHERE i BETWEEN ceil((centre - 6.4::DOUBLE + 20) / 0.8::DOUBLE) AND floor((centre + 6.4::DOUBLE + 20) / 0.8::DOUBLE) GROUP BY mod_base, is_mod, i""")
def calibrate_density_cells(spark, d):
    out = calibrate.densities(_stats(spark, d), ["mod_base", "is_mod"], -20.0, 20.0, 51)
    return out.select("mod_base", "is_mod", "i", r6("density").alias("density"))


def _kernel_sql(name: str, cells: str, grid: str, step: str, by: str) -> str:
    """CTEs {name}_d (unimodal densities by mod_base, is_mod, i) and {name}_p (share p of the modified) on a grid with low, pt."""
    up, down = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""{name}_y AS (SELECT g.mod_base, is_mod, i, pt, coalesce(sum(CASE WHEN i BETWEEN ceil((centre - 6.4::DOUBLE - low) / {step}) AND floor((centre + 6.4::DOUBLE - low) / {step}) THEN n * exp(-power((low + i * {step} - centre) / 0.8::DOUBLE, 2) / 2) END), 0) / (0.8 * sqrt(2 * pi())) / any_value(total) AS y
  FROM {grid} g JOIN {cells} USING (mod_base) JOIN t USING (mod_base, is_mod) GROUP BY ALL),
{name}_k AS (SELECT *, i < arg_max(i, (y, -i)) OVER (PARTITION BY mod_base, is_mod) AS before FROM {name}_y),
{name}_d AS (SELECT *, CASE WHEN before THEN (max(y) OVER up + min(y) OVER down) / 2 ELSE (min(y) OVER up + max(y) OVER down) / 2 END AS d FROM {name}_k
  WINDOW up AS (PARTITION BY mod_base, is_mod, before ORDER BY i {up}), down AS (PARTITION BY mod_base, is_mod, before ORDER BY i {down})),
{name}_s AS (SELECT mod_base, i, pt, max(CASE WHEN is_mod THEN d END) AS a, max(CASE WHEN NOT is_mod THEN d END) AS c FROM {name}_d GROUP BY ALL),
{name}_p AS (SELECT *, CASE WHEN a + c > 0 THEN a / (a + c) END AS p FROM {name}_s),
{name}_m AS (SELECT *, {by} AS middle FROM {name}_p),
{name}_q AS (SELECT *, CASE WHEN i < middle THEN CASE WHEN count(*) FILTER (p IS NULL) OVER down = 0 THEN max(p) OVER down END WHEN count(*) FILTER (p IS NULL) OVER up = 0 THEN min(p) OVER up END AS q FROM {name}_m
  WINDOW up AS (PARTITION BY mod_base, i < middle ORDER BY i {up}), down AS (PARTITION BY mod_base, i < middle ORDER BY i {down})),
{name}_l AS (SELECT *, CASE WHEN q <= 0 THEN 'inf'::DOUBLE WHEN q >= 1 THEN '-inf'::DOUBLE ELSE ln((1 - q) / q) END AS l FROM {name}_q)"""


@query(f"""WITH {o.LLRS}, s AS (SELECT mod_base, strand = 1 AS is_mod, round(llr, 2) AS llr FROM llrs),
c AS (SELECT mod_base, is_mod, round_even(llr / 0.008::DOUBLE, 0) * 0.008::DOUBLE AS centre, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT mod_base, is_mod, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT DISTINCT mod_base, i, -20::DOUBLE AS low, -20 + i * 0.8::DOUBLE AS pt FROM s, range(0, 51) r(i)),
{_kernel_sql("w", "c", "g", "0.8::DOUBLE", "26")},
mv AS (SELECT *, lead(l) OVER (PARTITION BY mod_base ORDER BY i) AS nx FROM w_l),
pl AS (SELECT mod_base, round_even(min(pt), 0) - 1 AS lo, round_even(max(pt), 0) + 1 AS hi FROM mv WHERE l <> nx AND nx - l > 1e-6 GROUP BY mod_base),
th AS (SELECT mod_base, coalesce(max(i) FILTER (before AND d < 5e-8), 0) AS lo, coalesce(min(i) FILTER (NOT before AND d < 5e-8) - 1, 50) AS hi FROM w_d GROUP BY mod_base),
rg AS (SELECT mod_base, greatest(pl.lo, round_even(-20 + th.lo * 0.8::DOUBLE, 0)) AS low, least(pl.hi, round_even(-20 + th.hi * 0.8::DOUBLE, 0)) AS high FROM pl JOIN th USING (mod_base)),
g2 AS (SELECT mod_base, i, low, high, (high - low) / 50 AS step, low + i * ((high - low) / 50) AS pt FROM rg, range(0, 51) r(i)),
{_kernel_sql("n", "c", "g2", "g.step", "arg_min(i, (abs(p - 0.5), i)) OVER (PARTITION BY mod_base)")}
SELECT mod_base, low AS lo, high AS hi, i::INTEGER AS i, round(l, 5) AS value FROM n_l JOIN rg USING (mod_base)""")
def calibrate_fit(spark, d):
    t = calibrate.fit(_stats(spark, d), max_llr=20.0, points=51)
    return t.select("mod_base", "lo", "hi", F.posexplode("table").alias("i", "value")).withColumn("value", F.round("value", 5))


def _variant_stats(spark, d):
    """Scores of variants of known truth: each read and alternative is a change, insertion or deletion by its numbers."""
    x = fx.var_calls(spark, d)
    k = F.col("locus") % 20
    bases = F.lit("ACGT")
    one = lambda i: F.substring(bases, (1 + i % 4).cast("int"), F.lit(1))
    ref = F.when(k < 14, one(F.col("locus"))).when(k < 17, F.concat(one(F.col("locus")), F.repeat(F.lit("G"), (k - 13).cast("int")))).otherwise(one(F.col("locus")))
    alt = F.when(k < 14, one(F.col("locus") + 1 + F.col("locus") % 3)).when(k < 17, one(F.col("locus"))).otherwise(F.concat(one(F.col("locus")), F.repeat(F.lit("G"), (k - 16).cast("int"))))
    llr = F.round(F.log1p(-F.exp("score")) - F.col("score"), 2)
    return x.select("read_id", ref.alias("ref_seq"), alt.alias("alt_seq"), llr.alias("llr"), F.when(F.col("read_id") % 7 == 0, "False").otherwise("True").alias("is_ref_correct"))


_VARIANT_STATS = f"""{o.VAR_CALLS}, vs AS (SELECT read_id, round(ln(1 - exp(score)) - score, 2) AS llr, read_id % 7 <> 0 AS ok, locus % 20 AS k, substr('ACGT', 1 + locus % 4, 1) AS r, substr('ACGT', 1 + (locus + 1 + locus % 3) % 4, 1) AS a FROM calls),
vk AS (SELECT *, CASE WHEN k < 14 THEN r || '>' || a WHEN k < 17 THEN 'del' || (k - 13) ELSE 'ins' || (k - 16) END AS key, CASE WHEN k < 14 THEN 1 ELSE 0 END AS single FROM vs)"""


@query(f"""WITH {_VARIANT_STATS}, n AS (SELECT key, count(*) AS n, round(sum(llr), 2) AS total, max(single) AS single FROM vk WHERE ok GROUP BY key)
SELECT key, n, total FROM n UNION ALL SELECT 'N>N', sum(n * single)::BIGINT // 12, NULL FROM n""")
def calibrate_variant_stats(spark, d):
    out = calibrate.variant_stats(_variant_stats(spark, d)).groupBy("key").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("llr") * F.col("n")), 2).alias("total"))
    return out.withColumn("total", F.when(F.col("key") != calibrate.GENERIC, F.col("total")))


@query(f"""WITH {_VARIANT_STATS}, have AS (SELECT DISTINCT key FROM vk WHERE key <> 'A>C' UNION ALL SELECT 'N>N'),
x AS (SELECT CASE WHEN key IN (SELECT key FROM have) THEN key ELSE 'N>N' END AS used, least(greatest(ceil((llr + 6) / 0.5), 0), 24) AS i FROM vk)
SELECT used AS key, count(*) AS n, round(sum((i - 12) * 0.25 + CASE WHEN used = 'N>N' THEN 100 ELSE length(used) END), 2) AS total FROM x GROUP BY used""")
def calibrate_variant_apply(spark, d):
    stats = _variant_stats(spark, d)
    base = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: (i - 12) * F.lit(0.25))
    keys = stats.select(calibrate.variant_key(F.col("ref_seq"), F.col("alt_seq")).alias("key")).distinct().where("key <> 'A>C'").unionByName(spark.range(1).select(F.lit(calibrate.GENERIC).alias("key")))
    tables = keys.select("key", F.lit(-6.0).alias("lo"), F.lit(6.0).alias("hi"), F.transform(base, lambda v: (v + F.when(F.col("key") == "N>N", 100).otherwise(F.length("key"))).cast("double")).alias("table"))
    # Alleles with bases that they share find the table of what is left of them.
    long = stats.select("read_id", F.when(F.length("ref_seq") == F.length("alt_seq"), F.concat(F.lit("CA"), "ref_seq", F.lit("T"))).otherwise(F.col("ref_seq")).alias("ref_seq"), F.when(F.length("ref_seq") == F.length("alt_seq"), F.concat(F.lit("CA"), "alt_seq", F.lit("T"))).otherwise(F.col("alt_seq")).alias("alt_seq"), "llr", calibrate.variant_key(F.col("ref_seq"), F.col("alt_seq")).alias("own"))
    out = calibrate.calibrate_variants(long, tables)
    return out.groupBy(F.when(F.col("own") == "A>C", "N>N").otherwise(F.col("own")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("calibrated"), 2).alias("total"))


@query(f"""WITH {o.LLRS}, x AS (SELECT chrm, pos, strand, read_id, mod_base, round(llr, 3) AS llr FROM llrs), g AS (SELECT *, least(greatest(ceil((llr + 8) / 0.25), 0), 64) AS i FROM x)
SELECT mod_base, count(*) AS n, round(sum(CASE WHEN mod_base = 'm' THEN (i - 32) * 0.125 ELSE llr END), 3) AS total FROM g GROUP BY mod_base""")
def calibrate_apply(spark, d):
    llrs = mods.site_llrs(fx.mod_calls(spark, d), ALPHABET).withColumn("llr", F.round("llr", 3))
    table = spark.range(1).select(F.lit("m").alias("mod_base"), F.lit(-8.0).alias("lo"), F.lit(8.0).alias("hi"), F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: (i - 32) * F.lit(0.125).cast("double")).alias("table"))
    c = calibrate.calibrate(llrs, table)
    return c.groupBy("mod_base").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("calibrated"), 3).alias("total"))


@query("""WITH v AS (SELECT p_partkey, substr('ACGTACGTACGT', 1 + p_partkey % 4, 1 + p_partkey % 3) AS ref, substr('TGCATGCATGCA', 1 + p_size % 4, 1 + p_size % 3) AS alt FROM part)
SELECT CASE WHEN length(ref) = length(alt) THEN CASE WHEN length(ref) = 1 THEN ref || '>' || alt ELSE 'N>N' END WHEN length(ref) > length(alt) THEN 'del' || (length(ref) - length(alt)) ELSE 'ins' || (length(alt) - length(ref)) END AS key, count(*) AS n FROM v GROUP BY 1""")
def calibrate_variant_keys(spark, d):
    k, z = F.col("p_partkey").cast("int"), F.col("p_size")
    v = read_table(spark, d, "part").select(F.substring(F.lit("ACGT" * 3), 1 + k % 4, 1 + k % 3).alias("ref"), F.substring(F.lit("TGCA" * 3), 1 + z % 4, 1 + z % 3).alias("alt"))
    return v.groupBy(calibrate.variant_key(F.col("ref"), F.col("alt")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_STRANDS = """v AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 2 AS side, p_partkey % 5 AS contig, p_partkey * 3 + (p_partkey % 2) * (p_size % 7) AS pos, 'v' || p_partkey AS id,
    substr('ACGGGGGTACGT', 1 + p_partkey % 5, 1 + p_partkey % 6) AS ref, CASE WHEN p_partkey % 3 = 0 THEN ['A', 'TTTTT'] ELSE ['G'] END AS alts, CASE WHEN p_partkey % 7 = 0 THEN '1' WHEN p_partkey % 4 = 0 THEN '0|1' ELSE '0/1' END AS gt,
    list_transform(range(1, 1 + CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END WHEN p_partkey % 3 = 0 THEN 6 ELSE 3 END), lambda i: -((p_partkey * 13 + p_size * 5 + i * 7) % 29) / 8::DOUBLE) AS gl, p_size AS dp FROM part),
y AS (SELECT *, pos + length(ref) AS fin, -(10 ** gl[1]) AS score, row_number() OVER (PARTITION BY side, contig ORDER BY pos, pos + length(ref), ref || '|' || array_to_string(alts, ',') || '|' || id) AS n FROM v),
fold AS (SELECT side, contig, n, k, fin, score, true AS fresh FROM y WHERE n = 1
  UNION ALL SELECT y.side, y.contig, y.n, CASE WHEN y.pos >= f.fin OR y.score > f.score THEN y.k ELSE f.k END, CASE WHEN y.pos >= f.fin OR y.score > f.score THEN y.fin ELSE f.fin END, CASE WHEN y.pos >= f.fin OR y.score > f.score THEN y.score ELSE f.score END, y.pos >= f.fin
  FROM fold f JOIN y ON y.side = f.side AND y.contig = f.contig AND y.n = f.n + 1),
kept AS (SELECT k FROM (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY side, contig ORDER BY n), true) AS last FROM fold) WHERE last),
best AS (SELECT *, list_max(gl[2:]) AS top, list_position(gl[2:], list_max(gl[2:])) AS g FROM y WHERE k IN (SELECT k FROM kept) AND dp >= 5 AND 10 ** gl[1] / 10 ** list_max(gl[2:]) <= 2.0),
two AS (SELECT *, CASE WHEN gt = '1' THEN [g, g] ELSE [[0, 1], [1, 1], [0, 2], [1, 2], [2, 2]][g] END AS al, CASE WHEN gt = '1' THEN '' ELSE substr(gt, 2, 1) END AS sep FROM best),
alt AS (SELECT *, list_sort(list_distinct(list_filter(al, lambda a: a > 0))) AS ks, 10 ** gl[1] / (10 ** gl[1] + 10 ** top) AS p0 FROM two),
out AS (SELECT *, list_transform([p0, 1 - p0], lambda p: greatest(log10(p), -999)) AS l, list_transform(ks, lambda a: alts[a]) AS chosen,
    CASE WHEN p0 > 0.5 THEN CASE WHEN sep = '' THEN '0' ELSE '0' || sep || '0' END WHEN sep = '' THEN '1' ELSE coalesce(list_position(ks, al[1]), 0) || sep || coalesce(list_position(ks, al[2]), 0) END AS call FROM alt),
rec AS (SELECT side, contig, pos, fin, id, ref, chosen AS alts, call AS gt, array_to_string(list_transform(l, lambda x: printf('%.2f', round_even(x * 100, 0) / 100 + 0.0)), ',') AS gl,
    array_to_string(list_transform(l, lambda x: round_even(least(-10 * x + 10 * list_max(l), 999), 0)::INTEGER), ',') AS pl, list_max(list_transform(l, lambda x: round_even(least(-10 * x + 10 * list_max(l), 999), 0)::INTEGER)) AS gq, round_even(least(-10 * l[1], 999), 0)::INTEGER AS qual, dp FROM out),
hp AS (SELECT *, list_max(list_transform(list_concat([ref], alts), lambda s: list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+'), lambda m: length(m))))) AS hp FROM rec)"""


@query(f"""WITH RECURSIVE {_STRANDS},
met AS (SELECT DISTINCT f.id AS f, r.id AS r FROM rec f JOIN rec r ON f.side = 0 AND r.side = 1 AND f.contig = r.contig AND f.pos <= r.fin AND r.pos <= f.fin)
SELECT contig, pos, id, ref, array_to_string(alts, ',') AS alts, gt, gl, pl, gq, qual, dp, CASE WHEN side = 0 AND id NOT IN (SELECT f FROM met) THEN 1 WHEN side = 1 THEN -1 END AS strand
FROM hp WHERE CASE WHEN side = 0 THEN id NOT IN (SELECT f FROM met) OR hp >= 4 ELSE id NOT IN (SELECT r FROM met) END""")
def variants_resolve(spark, d):
    k, z = F.col("p_partkey").cast("int"), F.col("p_size")
    size = F.when(k % 7 == 0, F.when(k % 3 == 0, 3).otherwise(2)).when(k % 3 == 0, 6).otherwise(3)
    v = read_table(spark, d, "part").select(
        k.alias("k"), (k % 5).cast("long").alias("contig"), (k * 3 + (k % 2) * (z % 7)).cast("long").alias("pos"), F.concat(F.lit("v"), k.cast("string")).alias("id"), F.substring(F.lit("ACGGGGGTACGT"), 1 + k % 5, 1 + k % 6).alias("ref"),
        F.when(k % 3 == 0, F.array(F.lit("A"), F.lit("TTTTT"))).otherwise(F.array(F.lit("G"))).alias("alts"), F.when(k % 7 == 0, "1").when(k % 4 == 0, "0|1").otherwise("0/1").alias("gt"),
        F.transform(F.sequence(F.lit(1), size), lambda i: -((k * 13 + z * 5 + i * 7) % 29) / F.lit(8.0)).alias("gl"), z.alias("dp"),
    )
    out = resolve.resolve(v.where("k % 2 = 0"), v.where("k % 2 = 1"), most_ratio=2.0, least_depth=5)
    two = F.array_join(F.transform("gl", lambda x: F.format_string("%.2f", x)), ",")
    return out.select("contig", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "gt", two.alias("gl"), F.array_join("pl", ",").alias("pl"), "gq", "qual", "dp", "strand")


@query("""WITH RECURSIVE v AS (SELECT p_partkey AS k, p_partkey % 5 AS contig, p_partkey AS pos, CASE WHEN p_partkey % 11 = 0 THEN 'ACGT' WHEN p_partkey % 3 = 0 THEN 'AC' ELSE 'A' END AS ref, CASE WHEN p_partkey % 11 = 0 THEN 'TTAA' WHEN p_partkey % 5 = 0 THEN 'AGG' ELSE 'G' END AS alt, p_size::DOUBLE AS qual FROM part),
y AS (SELECT *, pos + length(ref) AS fin, row_number() OVER (PARTITION BY contig ORDER BY pos, pos + length(ref), k) AS n FROM v WHERE k % 11 <> 0 AND NOT (ref = 'AC' AND alt IN ('G', 'AGG'))),
fold AS (SELECT contig, n, pos, fin, k, qual, true AS fresh FROM y WHERE n = 1
  UNION ALL SELECT y.contig, y.n, CASE WHEN y.pos >= f.fin OR y.qual > f.qual THEN y.pos ELSE f.pos END, CASE WHEN y.pos >= f.fin OR y.qual > f.qual THEN y.fin ELSE f.fin END,
    CASE WHEN y.pos >= f.fin OR y.qual > f.qual THEN y.k ELSE f.k END, CASE WHEN y.pos >= f.fin OR y.qual > f.qual THEN y.qual ELSE f.qual END, y.pos >= f.fin FROM fold f JOIN y ON y.contig = f.contig AND y.n = f.n + 1)
SELECT contig, pos AS start, fin AS "end", k AS id, qual FROM (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY contig ORDER BY n), true) AS last FROM fold) WHERE last""")
def phase_whatshap_filter(spark, d):
    from strandlake.plans import commands

    k = F.col("p_partkey")
    v = read_table(spark, d, "part").select((k % 5).alias("contig"), k.alias("pos"), k.alias("id"), F.when(k % 11 == 0, "ACGT").when(k % 3 == 0, "AC").otherwise("A").alias("ref"), F.array(F.when(k % 11 == 0, "TTAA").when(k % 5 == 0, "AGG").otherwise("G")).alias("alts"), F.col("p_size").cast("double").alias("qual"))
    return commands.COMMANDS["phase_variants whatshap_filter"](v)


# --- phasing --------------------------------------------------------------


@query("""WITH v AS (SELECT p_partkey % 5 AS contig, p_partkey AS pos, 'A' AS ref, 'G' AS alt, [-(p_size % 7) * 0.5, -(p_size % 3) * 0.5, -(p_size % 5) * 0.5] AS gl,
  CASE WHEN p_partkey % 4 <> 0 THEN [-(p_size % 4) * 0.3, -(p_partkey % 6) * 0.3] END AS g1, CASE WHEN p_partkey % 9 <> 0 THEN [-(p_partkey % 5) * 0.3, -(p_size % 6) * 0.3] END AS g2 FROM part),
p AS (SELECT *, gl[2] > gl[1] AND gl[2] >= gl[3] AS het, CASE WHEN gl[3] > gl[1] THEN '1/1' ELSE '0/0' END AS homo, 10 ** (g1[1] + g2[1]) AS a, 10 ** (g1[1] + g2[2]) AS b, 10 ** (g1[2] + g2[1]) AS c, 10 ** (g1[2] + g2[2]) AS e FROM v)
SELECT contig, pos, CASE WHEN NOT het OR g1 IS NULL OR g2 IS NULL THEN homo WHEN greatest(b, c) >= greatest(a, e) - 1e-12 THEN CASE WHEN b >= c - 1e-12 THEN '0|1' ELSE '1|0' END WHEN e > a THEN '1|1' ELSE '0|0' END AS gt FROM p""")
def phase_merge_haploid(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    p = read_table(spark, d, "part").select((k % 5).alias("contig"), k.alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.array(-(z % 7) * 0.5, -(z % 3) * 0.5, -(z % 5) * 0.5).alias("gl"),
                                            F.array(-(z % 4) * 0.3, -(k % 6) * 0.3).alias("h1"), F.array(-(k % 5) * 0.3, -(z % 6) * 0.3).alias("h2"))
    key = ["contig", "pos", "ref", "alt"]
    h1, h2 = p.where("pos % 4 <> 0").select(*key, F.col("h1").alias("gl")), p.where("pos % 9 <> 0").select(*key, F.col("h2").alias("gl"))
    return variants.merge_haploid_calls(p.select(*key, "gl"), h1, h2).select("contig", "pos", "gt")


@query("""WITH v AS (SELECT p_partkey AS id, substr('ACGTACGTACGT', 1 + p_partkey % 4, 1 + p_partkey % 3) AS ref, substr('TGCATGCATGCA', 1 + p_size % 4, 1 + p_size % 3) AS alt FROM part),
t AS (SELECT id, ref, alt, list_max([n for n in range(0, least(length(ref), length(alt)) + 1) if substr(ref, 1, n) = substr(alt, 1, n)]) AS b FROM v),
u AS (SELECT id, ref, alt, substr(ref, b + 1) AS r, substr(alt, b + 1) AS a FROM t),
w AS (SELECT id, ref, alt, r, a, list_max([n for n in range(0, least(length(r), length(a)) + 1) if right(r, n) = right(a, n)]) AS e FROM u)
SELECT id, ref, alt FROM w WHERE length(r) - e > 0 AND length(a) - e > 0 AND NOT (length(r) - e = 1 AND length(a) - e = 1)""")
def phase_complex_variants(spark, d):
    k, z = F.col("p_partkey").cast("int"), F.col("p_size")
    v = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring(F.lit("ACGT" * 3), 1 + k % 4, 1 + k % 3).alias("ref"), F.array(F.substring(F.lit("TGCA" * 3), 1 + z % 4, 1 + z % 3)).alias("alts"))
    return variants.complex_variants(v).select("id", "ref", F.col("alts")[0].alias("alt"))


@query("""SELECT hp, count(*) AS reads FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS hp FROM orders) WHERE hp IS NOT NULL GROUP BY hp""")
def phase_split_haplotypes(spark, d):
    k = F.col("o_custkey") % 3
    r = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.when(k == 0, 1).when(k == 1, 2).alias("hp"))
    return variants.split_haplotypes(r).groupBy("hp").agg(F.count(F.lit(1)).alias("reads"))


# --- B: scalar functions --------------------------------------------------


@query(f"""WITH {o.SEQS} SELECT name, sha256(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp_sha, sha256(translate(seq, 'C', 'T')) AS bisulfite_sha, length(seq) - length(replace(seq, 'A', '')) AS n_a FROM seqs""")
def functions_sequence(spark, d):
    s = fx.sequences(spark, d)
    return s.select("name", F.sha2(expr.reverse_complement("seq"), 256).alias("revcomp_sha"), F.sha2(expr.bisulfite("seq"), 256).alias("bisulfite_sha"), (F.length("seq") - F.length(F.replace("seq", F.lit("A"), F.lit("")))).cast("long").alias("n_a"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_discount AS d, l_tax AS t FROM lineitem)
SELECT k, n, p, d, t, round(CASE WHEN d = 0 THEN NULL ELSE -10 * log10(1 - exp(ln(d))) END, 6) AS phred, round(ln(1 - (d + t)), 6) AS canonical, round(1 / (1 + exp(-30.0 * (d * 9 - 0.8))), 6) AS weight,
       round(-ln(1 + exp(-d) + exp(-t)), 6) AS ref_lp, round(d - (greatest(d, t) + ln(exp(d - greatest(d, t)) + exp(t - greatest(d, t)))), 6) AS log_softmax, round_even(d * 100 / 4, 0) AS quarter FROM x""")
def functions_probability(spark, d):
    x = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    both = F.array("d", "t")
    return x.select("k", "n", "p", "d", "t", r6(F.when(F.col("d") > 0, expr.phred(expr.safe_ln("d")))).alias("phred"), r6(expr.log1m(F.col("d") + F.col("t"))).alias("canonical"), r6(expr.expit(F.col("d") * 9)).alias("weight"),
                    r6(F.get(expr.llrs_to_log_probs(both), F.lit(0))).alias("ref_lp"), r6(F.get(expr.log_softmax(both), F.lit(0))).alias("log_softmax"), F.rint(F.col("d") * 100 / 4).alias("quarter"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_median(v) AS med FROM (SELECT vec_id, v FROM e))
SELECT vec_id, round(med, 6) AS med, round(1.4826 * list_median(list_transform(v, lambda x: abs(x - med))), 6) AS mad, len(v) - 3 AS windows, round(list_sum(v[1:4]), 6) AS first_window FROM m""")
def functions_signal(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    mm, w = expr.med_mad("v"), expr.rolling_windows("v", 4)
    return e.select("vec_id", r6(mm["med"]).alias("med"), r6(mm["mad"]).alias("mad"), F.size(w).cast("long").alias("windows"), r6(expr.array_sum(F.get(w, F.lit(0)))).alias("first_window"))


@query("""SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, CASE WHEN lower(event_type) IN ('y', 'yes', 't', 'true', 'on', '1') THEN true ELSE false END AS flag,
  printf('%.6f', event_id / 4000.0) AS seconds, 'chr' || lpad((user_id % 25)::VARCHAR, 12, '0') AS natural_key FROM events""")
def functions_records(spark, d):
    e = read_table(spark, d, "events")
    info = expr.info_map(F.concat(F.lit("DB;k="), F.regexp_extract("props", r'"k": ([0-9]+)', 1)))
    flag = F.when(F.lower("event_type").isin(expr.TRUE_WORDS), True).otherwise(False)
    return e.select("event_id", info["k"].alias("k"), flag.alias("flag"), expr.seconds_text("event_id", F.lit(4000.0)).alias("seconds"), expr.natural_key(F.concat(F.lit("chr"), (F.col("user_id") % 25).cast("string"))).alias("natural_key"))


@query(f"""WITH {o.SEQS} SELECT name, len(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS runs FROM seqs""")
def functions_run_lengths(spark, d):
    # The letters are a column of their own, so that they are split once a row and not once a letter.
    s = fx.sequences(spark, d).select("name", F.when(F.length("seq") > 0, F.split("seq", "")).otherwise(F.array().cast("array<string>")).alias("letters"))
    return s.select("name", F.size(expr.run_lengths("letters")).cast("long").alias("runs"))


# --- writers --------------------------------------------------------------


_MOD_COUNTS = """a AS (SELECT m.mod_base, chrm, pos, strand, sum(CASE WHEN exp(win_lp) > 0.8 THEN 1 ELSE 0 END)::BIGINT AS v, sum(CASE WHEN exp(win_lp) > 0.8 AND winner = m.mod_base THEN 1 ELSE 0 END) AS n
  FROM winners CROSS JOIN (VALUES ('h'), ('m')) AS m(mod_base) GROUP BY ALL)"""


@query(f"""WITH {o.WINNERS}, {_MOD_COUNTS}
SELECT mod_base, chrm, pos, concat_ws(chr(9), chrm, pos, pos + 1, '.', least(v, 1000), CASE strand WHEN 1 THEN '+' ELSE '-' END, pos, pos + 1, '0,0,0', v, printf('%.1f', CASE WHEN v > 0 THEN round_even(1000 * (n / v), 0) / 10 ELSE 0.0 END)) AS value FROM a""")
def writer_bed_methyl(spark, d):
    from strandlake.sources import text

    return text.bed_methyl_lines(mods.binary_threshold(fx.mod_calls(spark, d), mods=ALPHABET))


@query(f"""WITH {o.WINNERS}, {_MOD_COUNTS}
SELECT mod_base, strand, chrm, pos, (pos + 1) || ' ' || printf('%.6f', CASE WHEN v > 0 THEN n / v ELSE 0.0 END) AS value FROM a""")
def writer_wiggle(spark, d):
    from strandlake.sources import text

    return text.wiggle_lines(mods.binary_threshold(fx.mod_calls(spark, d), mods=ALPHABET))


@query(f"""WITH {o.WINNERS}, {_MOD_COUNTS}, w AS (SELECT mod_base || '.' || CASE strand WHEN 1 THEN 'fwd_strand' ELSE 'rev_strand' END AS file, chrm, pos, (pos + 1) || ' ' || printf('%.6f', CASE WHEN v > 0 THEN n / v ELSE 0.0 END) AS value FROM a)
SELECT file, 1 AS part, chrm, pos, value FROM w UNION ALL SELECT DISTINCT file, 1, chrm, -1, 'variableStep chrom=' || chrm || ' span=1' FROM w
UNION ALL SELECT DISTINCT file, 0, '', -1, 'track type=wiggle_0 name="' || file || '" description="' || file || '"' FROM w""")
def writer_wiggle_files(spark, d):
    from strandlake.sources import text

    return text.wiggle_files(mods.binary_threshold(fx.mod_calls(spark, d), mods=ALPHABET))


@query(f"""WITH {o.SEQS}, s AS (SELECT *, 'chr' || (name % 5) AS chrm FROM seqs)
SELECT 2 AS part, name % 5 AS number, chrm, name AS pos, name || chr(9) || (CASE WHEN name % 2 = 0 THEN 0 ELSE 16 END + CASE WHEN name % 3 = 0 THEN 2048 ELSE 0 END) || chr(9) || chrm || chr(9) || (name + 1) || chr(9) || '60' || chr(9) || length(seq) || 'M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || seq || chr(9) || '*' AS value FROM s
UNION ALL SELECT 1, any_value(name % 5), chrm, -1, '@SQ' || chr(9) || 'SN:' || chrm || chr(9) || 'LN:' || (max(name + length(seq)) + 1) FROM s GROUP BY chrm
UNION ALL SELECT 0, -1, '', -1, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:coordinate'""")
def writer_sam_file(spark, d):
    from strandlake.sources import text

    n = F.col("name")
    a = fx.sequences(spark, d).select(n.cast("string").alias("read_id"), F.concat(F.lit("chr"), (n % 5).cast("string")).alias("chrm"), n.alias("pos"), F.when(n % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit(60).alias("mapq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), "seq", F.lit(None).cast("string").alias("qual"), F.array().cast("array<string>").alias("tags"), F.when(n % 3 == 0, 1).otherwise(0).alias("map_num"))
    contigs = a.groupBy("chrm").agg((F.max(F.col("pos") + F.length("seq")) + 1).alias("chrm_len"), F.min(F.col("pos") % 5).alias("number"))
    return text.sam_file(a, contigs)


@query(f"""WITH {o.WINNERS}, a AS (SELECT chrm, pos, strand, count(*) AS r, sum(CASE WHEN exp(win_lp) > 0.8 THEN 1 ELSE 0 END)::BIGINT AS v, sum(CASE WHEN exp(win_lp) > 0.8 AND winner = 'm' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN exp(win_lp) > 0.8 AND winner = 'h' THEN 1 ELSE 0 END) AS h FROM winners GROUP BY ALL)
SELECT chrm, pos, concat_ws(chr(9), chrm, pos + 1, '.', 'C', '.', '.', '.', 'DP=' || r || ';STRD=' || CASE strand WHEN 1 THEN '+' ELSE '-' END, 'VALID_DP:h:m', v || ':' || printf('%.4f', CASE WHEN v > 0 THEN round(h / v, 4) ELSE 0.0 END) || ':' || printf('%.4f', CASE WHEN v > 0 THEN round(n / v, 4) ELSE 0.0 END)) AS value FROM a""")
def writer_mod_vcf(spark, d):
    from strandlake.sources import text

    calls = mods.binary_threshold(fx.mod_calls(spark, d), mods=ALPHABET).withColumn("prop", F.round("prop", 4))
    return text.mod_vcf_lines(calls)


@query("""SELECT '@' || doc_id || chr(10) || s || chr(10) || '+' || chr(10) || repeat('!', length(s)) AS value FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)""")
def writer_fastq(spark, d):
    from strandlake.sources import text

    s = fx.sequences(spark, d).select(F.col("name").cast("string").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
    return text.fastq_lines(s)


# --- J: streaming; H: kernels ---------------------------------------------


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL""")
def streaming_running_counts(spark, d):
    from strandlake.streaming import live

    return live.running_counts_to_table(spark, f"{d}/events.parquet")


_GOOD_READS = """al AS (SELECT o_orderkey AS read_id, 20 + o_custkey % 80 AS m, o_custkey % 7 AS i FROM orders),
marked AS (SELECT *, CASE WHEN m < 30 THEN 'reference too short' WHEN 100.0 * m / (m + i) < 93 THEN 'identity' END AS reason FROM al),
good AS (SELECT read_id FROM marked WHERE reason IS NULL)"""


def _alignments(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cigar = F.concat((20 + c % 80).cast("string"), F.lit("M"), F.when(c % 7 > 0, F.concat((c % 7).cast("string"), F.lit("I"))).otherwise(""))
    return read_table(spark, d, "orders").select(k.cast("string").alias("read_id"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chrm"), ((k * 37) % 2000).alias("pos"), F.when(c % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit(60).alias("mapq"), cigar.alias("cigar"), F.lit(0).alias("map_num"))


def _main_run(spark, d):
    """A main run into a fresh folder: its name and its counts."""
    from strandlake.plans import main_run
    from strandlake.plans.settings import RunSettings

    out = f"{work_dir(spark)}/strandlake/run-{uuid.uuid4().hex}"
    settings = RunSettings(outputs=("mods",), ref_length_range=(30, None), percent_identity=93.0)
    return out, main_run.run(settings, out, _alignments(spark, d), fx.mod_calls(spark, d).withColumn("read_id", F.col("read_id").cast("string")))


@query(f"""WITH {_GOOD_READS}, {o.WINNERS.replace("FROM lineitem", "FROM lineitem JOIN good ON l_orderkey = good.read_id")}, {_MOD_COUNTS}
SELECT mod_base, concat_ws(chr(9), chrm, pos, pos + 1, '.', least(v, 1000), CASE strand WHEN 1 THEN '+' ELSE '-' END, pos, pos + 1, '0,0,0', v, printf('%.1f', CASE WHEN v > 0 THEN round_even(1000 * (n / v), 0) / 10 ELSE 0.0 END)) AS value FROM a""")
def main_run_bed_methyl(spark, d):
    out, _ = _main_run(spark, d)
    return spark.read.text(f"{out}/mods/bedmethyl").select("mod_base", "value")


@query(f"""WITH {_GOOD_READS} SELECT read_id::VARCHAR AS read_id, reason FROM marked WHERE reason IS NOT NULL""")
def main_run_rejected(spark, d):
    out, _ = _main_run(spark, d)
    return spark.read.parquet(f"{out}/rejected").select("read_id", "reason")


@query("""SELECT CASE WHEN o_totalprice < 20000 THEN 'short' WHEN o_orderpriority LIKE '5%' THEN 'no mapping' WHEN o_orderstatus = 'P' THEN 'unfinished' ELSE 'good' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def reporting_reasons(spark, d):
    from strandlake.streaming import reporting

    rules = {"short": F.col("o_totalprice") >= 20000, "no mapping": ~F.col("o_orderpriority").startswith("5"), "unfinished": F.col("o_orderstatus") != "P"}
    return reporting.reason_counts(reporting.mark(read_table(spark, d, "orders"), rules))


def _mod_store(spark, d, rows, name):
    from strandlake.sources import store

    contigs = fx.mod_contigs(spark, d)
    bases = spark.createDataFrame([("m", "C", "5mC"), ("h", "C", "5hmC")], "mod_base string, can_base string, long_name string")
    made = store.create(spark, f"{work_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}", "mods", contigs, bases)
    return store.add(made, rows.withColumn("read_id", F.col("read_id").cast("string")))


@query(f"""WITH {o.MOD_CALLS} SELECT chrm, pos, strand, read_id::VARCHAR AS read_id, mod_base, score FROM calls WHERE chrm = 'chr1' AND pos >= 100 AND pos < 700""")
def store_region(spark, d):
    return _mod_store(spark, d, fx.mod_calls(spark, d), "store").within("chr1", 100, 700)


@query(f"""WITH {o.MOD_CALLS} SELECT chrm, pos, strand, count(*) AS n, count(DISTINCT read_id) AS reads FROM calls GROUP BY ALL""")
def store_merged_sites(spark, d):
    """Two runs that share a third of their reads, merged."""
    from strandlake.sources import store

    calls = fx.mod_calls(spark, d)
    parts = [_mod_store(spark, d, calls.where(F.col("read_id") % 3 != k), "run") for k in (0, 1)]
    return store.merge(parts, f"{work_dir(spark)}/strandlake/merged-{uuid.uuid4().hex}").sites()


@query()
def kernels_posterior_calls(spark, d):
    from strandlake.functions import kernels

    e = read_table(spark, d, "embeddings")
    return kernels.decode_table(e.select(F.col("vec_id").alias("read_id"), F.col("embedding").cast("array<double>").alias("values")))


# --- further functions, tags, writers and checks --------------------------


@query("""WITH c AS (SELECT l_orderkey AS read_id, l_linenumber * 3 + l_linenumber % 2 AS ordinal, max(l_discount) * 9 AS prob FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT *, ordinal - coalesce(lag(ordinal) OVER (PARTITION BY read_id ORDER BY ordinal), -1) - 1 AS skip, least(floor(prob * 256), 255)::INTEGER AS b FROM c WHERE prob >= 0.25)
SELECT read_id, 'C+m,' || string_agg(skip::VARCHAR, ',' ORDER BY ordinal) || ';' AS mm, string_agg(b::VARCHAR, ',' ORDER BY ordinal) AS ml FROM k GROUP BY read_id""")
def reads_mod_tags(spark, d):
    from strandlake.operators import reads

    n = F.col("l_linenumber")
    c = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_discount") * 9).alias("prob"))
    c = c.select(F.col("l_orderkey").alias("read_id"), F.lit("C").alias("can_base"), F.lit("m").alias("mod_base"), (n * 3 + n % 2).alias("ordinal"), "prob")
    return reads.mod_tags(c, 0.25)


@query(f"""WITH {o.SEQS} SELECT name, coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0)::INTEGER AS longest FROM seqs""")
def functions_homopolymer(spark, d):
    return fx.sequences(spark, d).select("name", expr.homopolymer_length("seq").alias("longest"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x + 3.0) * 0.5)), 6) AS posterior_sum, round(list_sum(list_transform(v, lambda x: (x + 10.0) * 1400.0 / 8192.0)), 6) AS current_sum FROM e""")
def functions_stored_signal(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    post, pico = expr.stored_posterior("v", F.lit(3.0), F.lit(0.5)), expr.to_picoamps("v", F.lit(10.0), F.lit(1400.0), F.lit(8192.0))
    return e.select("vec_id", r6(expr.array_sum(post)).alias("posterior_sum"), r6(expr.array_sum(pico)).alias("current_sum"))


@query("""WITH v AS (SELECT p_partkey AS id, substr('ACGTACGTACGT', 1 + p_partkey % 4, 1 + p_partkey % 5) AS ref, substr('ACGTTCGTACGA', 1 + p_size % 4, 1 + p_size % 6) AS alt FROM part),
s AS (SELECT *, list_max([n for n in range(0, least(length(ref), length(alt))) if right(ref, n) = right(alt, n)]) AS e FROM v),
t AS (SELECT id, left(ref, length(ref) - e) AS r, left(alt, length(alt) - e) AS a FROM s), u AS (SELECT *, list_max([n for n in range(0, least(length(r), length(a))) if left(r, n) = left(a, n)]) AS b FROM t)
SELECT id, substr(r, b + 1) AS ref, substr(a, b + 1) AS alt, b::INTEGER AS before FROM u""")
def functions_trim_padding(spark, d):
    k, z = F.col("p_partkey").cast("int"), F.col("p_size")
    v = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring(F.lit("ACGTACGTACGT"), 1 + k % 4, 1 + k % 5).alias("ref"), F.substring(F.lit("ACGTTCGTACGA"), 1 + z % 4, 1 + z % 6).alias("alt"))
    return v.select("id", expr.trim_padding("ref", "alt").alias("t")).select("id", "t.ref", "t.alt", "t.before")


@query(f"""WITH {o.MOD_CALLS} SELECT 'Order#' || read_id AS uuid, mod_base, score FROM calls WHERE chrm = 'chr2' AND pos = 42 AND strand = 1""")
def mods_at_one_site(spark, d):
    x = fx.mod_calls(spark, d).where("chrm = 'chr2' and pos = 42 and strand = 1")
    return x.select(F.concat(F.lit("Order#"), F.col("read_id").cast("string")).alias("uuid"), "mod_base", "score")


@query("""SELECT user_id, count(*) AS violations FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value < b GROUP BY user_id""")
def sites_order_violations(spark, d):
    e = read_table(spark, d, "events")
    return intervals.is_sorted(e, ["user_id"], "value", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("violations"))


@query(f"""WITH {o.LLRS} SELECT mod_base, is_mod, count(*) AS n, round(avg(llr), 6) AS mean_llr FROM (SELECT mod_base, strand = -1 AS is_mod, llr FROM llrs WHERE mod_base = 'm') GROUP BY ALL""")
def calibrate_mod_stats(spark, d):
    from strandlake.plans.commands import generate_mod_stats

    c = fx.mod_calls(spark, d)
    # Both mods stay in the calls, so canonical chances are those of the whole alphabet; one is asked for.
    stats = generate_mod_stats(c.where("strand = 1"), c.where("strand = -1"), exclude=["h"])
    return stats.groupBy("mod_base", "is_mod").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("llr")).alias("mean_llr"))


@query(f"""WITH {o.SEQS} SELECT name || chr(9) || CASE WHEN name % 2 = 0 THEN '0' ELSE '16' END || chr(9) || 'chr' || (name % 5) || chr(9) || (name + 1) || chr(9) || '60' || chr(9) || length(seq) || 'M' || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || seq || chr(9) || '*' || chr(9) || 'NM:i:0' AS value FROM seqs""")
def writer_sam(spark, d):
    from strandlake.sources import text

    n = F.col("name")
    a = fx.sequences(spark, d).select(n.cast("string").alias("read_id"), F.concat(F.lit("chr"), (n % 5).cast("string")).alias("chrm"), n.alias("pos"), F.when(n % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit(60).alias("mapq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), "seq", F.lit(None).cast("string").alias("qual"), F.array(F.lit("NM:i:0")).alias("tags"))
    return text.sam_lines(a)


@query(f"""WITH {o.DIPLOID}, gl AS (SELECT locus, reads, gt, list_transform([lp00, lp01, lp11, lp02, lp12, lp22], lambda x: greatest(round(x, 4) / ln(10), -999)) AS gl FROM wide),
raw AS (SELECT *, list_transform(gl, lambda x: round_even(-10 * x, 0)) AS raw FROM gl), pl AS (SELECT *, list_transform(raw, lambda x: least(x - list_min(raw), 999)::INTEGER) AS pl FROM raw)
SELECT 'chr' || (locus % 5) AS contig, locus AS pos, concat_ws(chr(9), 'chr' || (locus % 5), locus + 1, '.', 'C', 'A,T', CASE WHEN round_even(abs(-10 * gl[1]), 0) > 0 THEN round_even(abs(-10 * gl[1]), 0)::INTEGER::VARCHAR ELSE '.' END, '.', 'DP=' || reads, 'GT:DP:GQ:GL:PL',
  concat_ws(':', ['0/0', '0/1', '1/1', '0/2', '1/2', '2/2'][gt + 1], reads, list_sort(pl)[2], array_to_string(list_transform(gl, lambda x: printf('%.2f', round_even(x * 100, 0) / 100 + 0.0)), ','), array_to_string(pl, ','))) AS value FROM pl""")
def writer_vcf(spark, d):
    from strandlake.sources import text

    out = variants.diploid(fx.var_calls(spark, d)).withColumn("log_probs", F.transform("log_probs", lambda x: F.round(x, 4)))
    x = out.select(F.concat(F.lit("chr"), (F.col("locus") % 5).cast("string")).alias("contig"), F.col("locus").alias("pos"), F.lit("C").alias("ref"), F.slice("alleles", 2, 2).alias("alts"), "reads", "genotypes", "log_probs", "gt")
    return text.vcf_lines(x)
