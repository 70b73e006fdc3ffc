"""Per-read tables derived from the synthetic star schema, where no sequencing data exist.

Each function has a twin in SQL in ``strandlake.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import deal, read_table

SITE = ["chrm", "pos", "strand"]


def mod_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a site and read: p_m and p_h, whose sum stays below 1."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")).alias("chrm"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("strand"), F.col("l_orderkey").alias("read_id"), "l_discount", "l_tax"
    )
    # Hardly a row repeats another's site and read, so rows are dealt out first: grouped where they lie, a split of the file would be held whole.
    return deal(li, *SITE, "read_id").groupBy(*SITE, "read_id").agg((9 * F.max("l_discount")).alias("p_m"), F.max("l_tax").alias("p_h"))


def mod_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: chrm, pos, strand, read_id, mod_base, score (natural log, six decimals)."""
    wide = mod_probabilities(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(m).alias("mod_base"), F.round(F.log(F.greatest(F.col(f"p_{m}"), F.lit(1e-6))), 6).alias("score")) for m in ("h", "m")])
    return wide.select(*SITE, "read_id", F.explode(pairs).alias("x")).select(*SITE, "read_id", "x.mod_base", "x.score")


def mod_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrm, chrm_len of :func:`mod_calls`, straight from the table: which reads there are does not matter."""
    key = F.col("l_partkey")
    return read_table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrm")).agg((F.max("l_partkey") + 1).alias("chrm_len"))


def var_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: locus, read_id, alt_seq (A or T), score, for a reference base C."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus"), F.col("l_orderkey").alias("read_id"), "l_discount", "l_tax")
    wide = deal(li, "locus", "read_id").groupBy("locus", "read_id").agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    score = lambda p: F.round(F.log(F.greatest(p, F.lit(1e-6))), 6)
    pairs = F.array(F.struct(F.lit("A").alias("alt_seq"), score(4 * F.col("d")).alias("score")), F.struct(F.lit("T").alias("alt_seq"), score(5 * F.col("t")).alias("score")))
    return wide.select("locus", "read_id", F.explode(pairs).alias("x")).select("locus", "read_id", "x.alt_seq", "x.score")


def bed_methyl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by sample: chrom, pos, strand, sample, cov, mod_cov, pct (one decimal)."""
    li = read_table(spark, sf_dir, "lineitem")
    out = li.groupBy(
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string")).alias("chrom"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("strand"), F.col("l_returnflag").alias("sample")
    ).agg(F.count(F.lit(1)).alias("cov"), F.sum((F.col("l_discount") > 0.05).cast("long")).alias("mod_cov"))
    return out.withColumn("pct", F.rint(1000.0 * F.col("mod_cov") / F.col("cov")) / 10)


def read_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") * 37) % 2000
    return o.select(F.col("o_orderkey").alias("read_id"), (F.col("o_orderkey") % 5).alias("contig"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("strand"), start.alias("r_st"), (start + 20 + F.col("o_custkey") % 80).alias("r_en"))


def interval_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 5).alias("contig"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("strand"))


def variant_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate variants with spans and a probability: contig, start, end, id, qual."""
    p = read_table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 3
    return p.select((F.col("p_partkey") % 5).alias("contig"), start.alias("start"), (start + 1 + (F.col("p_partkey") * 7) % 23).alias("end"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("qual"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters A, C, G, T of each document: name, seq."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
