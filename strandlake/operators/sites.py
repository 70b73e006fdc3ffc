"""Aggregated methylation tables: sum, merge, compare, label, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.expr import motif_complement, natural_key
from strandlake.operators import tiles

#: Bins of the comparison histogram over 0..100 percent.
COMPARE_BINS = 31


def sum_records(records: DataFrame, strand_offset: int | None = None, keys: tuple[str, ...] = ("chrom", "strand", "pos")) -> DataFrame:
    """chrom, strand, pos, cov, mod_cov over records with cov and pct; modified counts are round(pct * cov / 100).

    With a strand offset, reverse positions move back by it and strands merge (strand null).
    """
    r = records.where("cov > 0").withColumn("m", F.rint(F.col("pct") * F.col("cov") / 100).cast("long"))
    if strand_offset is not None:
        r = r.withColumn("pos", F.when(F.col("strand") == -1, F.col("pos") - strand_offset).otherwise(F.col("pos"))).withColumn("strand", F.lit(None).cast("int"))
    return r.groupBy(*keys).agg(F.sum("cov").alias("cov"), F.sum("m").alias("mod_cov"))


def percent(digits: int = 1) -> Column:
    s = 10.0**digits
    return F.rint(100.0 * s * F.col("mod_cov") / F.col("cov")) / s


def merge(tables: list[DataFrame]) -> DataFrame:
    """Several aggregated tables as one: counts add up, the percentage has one decimal."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return sum_records(out).withColumn("pct", percent())


def in_genome_order(records: DataFrame) -> DataFrame:
    return records.orderBy(natural_key("chrom"), "chrom", "pos", F.col("strand").desc_nulls_last())


def ground_truth(summed: DataFrame, low: float = 10.0, high: float = 90.0, least: int = 1, strand_offset: int | None = None) -> DataFrame:
    """chrom, strand, pos, is_mod of sites that are clearly one or the other; with an offset both strands' positions."""
    pct = 100.0 * F.col("mod_cov") / F.col("cov")
    x = summed.where(F.col("cov") >= least).withColumn("is_mod", F.when(pct <= low, False).when(pct >= high, True)).where("is_mod is not null")
    if strand_offset is None:
        return x.select("chrom", "strand", "pos", "is_mod")
    both = F.array(F.struct(F.lit(1).alias("strand"), F.col("pos").alias("pos")), F.struct(F.lit(-1).alias("strand"), (F.col("pos") + strand_offset).alias("pos")))
    return x.select("chrom", F.explode(both).alias("s"), "is_mod").select("chrom", "s.strand", "s.pos", "is_mod")


def coverage_stats(summed: DataFrame, by: list[str]) -> DataFrame:
    return summed.groupBy(*by).agg(F.count(F.lit(1)).alias("sites"), F.median("cov").alias("median_cov"), F.avg("cov").alias("mean_cov"), F.stddev_pop("cov").alias("sd_cov"))


def paired(a: DataFrame, b: DataFrame, least: int = 1) -> DataFrame:
    """chrom, strand, pos, pct_a, pct_b at sites that both cover at least ``least`` times."""
    key = ["chrom", "strand", "pos"]
    side = lambda t, n: t.where(F.col("cov") >= least).select(*key, (100.0 * F.col("mod_cov") / F.col("cov")).alias(f"pct_{n}"))
    return side(a, "a").join(side(b, "b"), key)


def comparison(pairs: DataFrame) -> DataFrame:
    """sites, r, r2, rmse to the diagonal."""
    return pairs.agg(F.count(F.lit(1)).alias("sites"), F.corr("pct_a", "pct_b").alias("r"), F.pow(F.corr("pct_a", "pct_b"), 2).alias("r2"), F.sqrt(F.avg(F.pow(F.col("pct_a") - F.col("pct_b"), 2))).alias("rmse"))


def histogram_2d(pairs: DataFrame, bins: int = COMPARE_BINS) -> DataFrame:
    b = lambda c: F.least(F.floor(F.col(c) * bins / 100.0), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(b("pct_a").alias("bin_a"), b("pct_b").alias("bin_b")).agg(F.count(F.lit(1)).alias("n"))


def coverage_histogram(summed: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """cov, n between two shares of the cumulative count; coverages are few, so the running sum is small."""
    h = summed.groupBy("cov").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("cov").rowsBetween(Window.unboundedPreceding, 0)
    x = h.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(h.agg(F.sum("n").alias("all_n"))))
    return x.where((F.col("upto") > low * F.col("all_n")) & (F.col("upto") - F.col("n") < high * F.col("all_n"))).select("cov", "n")


def motif_sites(contigs: DataFrame, motif: str, offset: int, width: int = tiles.WIDTH) -> DataFrame:
    """chrom, pos, strand of a motif's base on both strands, from whole contigs (chrom, seq) or tiles."""
    cut = tiles.of(contigs, "chrom", width)
    hits = lambda m, at, strand: tiles.motif_starts(cut, m, width).select(F.col("contig").alias("chrom"), (F.col("pos") + at).alias("pos"), F.lit(strand).alias("strand"))
    return hits(motif, offset, 1).unionByName(hits(motif_complement(motif), len(motif) - 1 - offset, -1))


def split_by_motif(sites: DataFrame, contigs: DataFrame, motifs: list[tuple[str, int]], width: int = tiles.WIDTH) -> DataFrame:
    """Adds motif: the first that reads at the site on its strand, else null. Sites join the motifs' hits, so that no site carries letters."""
    cut = tiles.of(contigs, "chrom", width)
    hits = None
    for rank, (motif, offset) in enumerate(motifs):
        x = motif_sites(cut, motif, offset, width).withColumn("_rank", F.lit(rank))
        hits = x if hits is None else hits.unionByName(x)
    best = hits.groupBy("chrom", "pos", F.col("strand").alias("_strand")).agg(F.min("_rank").alias("_rank"))
    names = F.get(F.array(*[F.lit(m) for m, _ in motifs]), F.col("_rank"))
    known = sites.join(cut.select(F.col("contig").alias("chrom")).distinct(), "chrom", "left_semi").withColumn("_strand", F.when(F.col("strand") == 1, 1).otherwise(-1))
    return known.join(best, ["chrom", "pos", "_strand"], "left").select(*sites.columns, names.alias("motif"))


# --- unions of per-read tables and of calibrations ------------------------


def merge_per_read(tables: list[DataFrame], site: list[str]) -> DataFrame:
    """Per-read scores of several runs; reads are known by uuid, repeated rows keep the largest score."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*site, "uuid", "mod_base").agg(F.max("score").alias("score"))


def check_contigs(tables: list[DataFrame]) -> DataFrame:
    """Contigs whose length differs between tables: a merge must not go on with any."""
    out = tables[0].select("chrm", "chrm_len")
    for t in tables[1:]:
        out = out.unionByName(t.select("chrm", "chrm_len"))
    return out.groupBy("chrm").agg(F.countDistinct("chrm_len").alias("lengths")).where("lengths > 1")


def first_listed(tables: list[DataFrame], key: str) -> DataFrame:
    """A row a key, from the earliest table that has it."""
    out = None
    for i, t in enumerate(tables):
        x = t.withColumn("_at", F.lit(i))
        out = x if out is None else out.unionByName(x)
    w = Window.partitionBy(key).orderBy("_at")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def surrogate_keys(values: DataFrame, column: str, name: str) -> DataFrame:
    """Stable 64-bit keys without a global order."""
    return values.select(column).distinct().withColumn(name, F.xxhash64(column))
