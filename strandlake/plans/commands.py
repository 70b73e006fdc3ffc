"""Commands by name: each takes a session and keyword parameters, and returns DataFrames or writes folders.

Inputs are DataFrames, so a caller may read them from any source; ``None`` marks commands that need software
or data outside this engine (neural networks, aligners, binary read files).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.expr import natural_key
from strandlake.operators import calibrate, intervals, mods, reads, resolve, sites, validate, variants
from strandlake.plans.settings import check_motifs, split_alphabet
from strandlake.sources import text


def aggregate_run(mod_calls: DataFrame | None = None, var_calls: DataFrame | None = None, method: str = "binary_threshold", haploid: bool = False, het_factor: float | tuple[float, float] = 1.0, read_ids: DataFrame | None = None, valid_sites: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    out = {}
    if mod_calls is not None:
        out["mods"] = mods.aggregate(mod_calls, method, read_ids, valid_sites, **options)
    if var_calls is not None:
        v = var_calls if read_ids is None else var_calls.join(read_ids.select("read_id").distinct(), "read_id", "left_semi")
        out["variants"] = variants.haploid(v) if haploid else variants.diploid(v, het_factor)
    return out


def generate_mod_stats(can_calls: DataFrame, mod_calls: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """mod_base, is_mod, llr of mods both runs know, less those left out."""
    alphabets = [mods.alphabet(c) for c in (can_calls, mod_calls)]
    names = set(alphabets[0]) & set(alphabets[1])
    names = sorted((names & set(include) if include else names) - set(exclude or ()))
    # Canonical chances are those of each run's whole alphabet; only the rows are limited.
    rows = [mods.site_llrs(c, known).where(F.col("mod_base").isin(names)).select("mod_base", F.lit(flag).alias("is_mod"), "llr") for c, known, flag in zip((can_calls, mod_calls), alphabets, (False, True), strict=True)]
    return rows[0].unionByName(rows[1])


def merge_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def merge_variants(tables: list[DataFrame]) -> DataFrame:
    """Reads are known by uuid and strand; repeated rows keep the largest score."""
    return merge_all(tables).groupBy("contig", "pos", "ref_seq", "alt_seq", "uuid", "strand").agg(F.max("score").alias("score"))


def index_by_position(calls: DataFrame, path: str, site: tuple[str, ...] = ("chrm", "pos", "strand")) -> None:
    """Range-clustered, sorted files: statistics of a row group then bound its positions."""
    calls.repartitionByRange(*site).sortWithinPartitions(*site, "read_id").write.parquet(path)


def whatshap_filter(records: DataFrame) -> DataFrame:
    """Without complex variants, and of overlapping ones the best by quality (the survivor of a pass in order)."""
    simple = records.join(variants.complex_variants(records).select("id"), "id", "left_anti")
    return intervals.resolve_overlaps(simple.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.greatest(F.length("ref"), F.lit(1))), ["contig"], "qual", "id")


def resolve_variants(forward: DataFrame, reverse: DataFrame, most_ratio: float = 1.0) -> DataFrame:
    """Best non-reference calls of both strands that do not overlap: contig, start, end, id, qual.

    Rows: contig, start, end, id, qual, gl (log10). A row counts if its reference is at most ``most_ratio`` times as likely as its
    best other genotype.
    """
    both = forward.unionByName(reverse)
    best_other = F.array_max(F.slice("gl", 2, F.size("gl")))
    kept = both.where((F.col("gl")[0] - best_other) <= F.log10(F.lit(float(most_ratio))))
    return intervals.resolve_overlaps(kept, ["contig"], "qual", "id")


def validate_results(stats: DataFrame, mapped: DataFrame | None = None) -> dict[str, DataFrame]:
    """stats: sample, mod_base, is_mod, llr. The positive class is canonical; classes are balanced by hash order."""
    rows = validate.clean_scores(stats.select("sample", "mod_base", (~F.col("is_mod")).cast("int").alias("label"), F.col("llr").alias("score"), F.monotonically_increasing_id().alias("row")))
    out = {"mods": validate.summary(validate.balanced(rows, ["sample", "mod_base"], "label", "row"), ["sample", "mod_base"])}
    if mapped is not None:
        out["accuracy"] = validate.accuracy_summary(mapped, ["sample"])
    return out


def validate_aggregated(summed: DataFrame, truth: DataFrame, least: int = 1) -> dict[str, DataFrame]:
    """The positive class is modified; the score is the modified percentage."""
    key = ["chrom", "strand", "pos"]
    rows = summed.where(F.col("cov") >= least).join(truth, key).select(F.lit("all").alias("k"), F.col("is_mod").cast("int").alias("label"), (100.0 * F.col("mod_cov") / F.col("cov")).alias("score"))
    return {"coverage": sites.coverage_stats(summed.withColumn("k", F.lit("all")), ["k"]), "curve": validate.curve(rows, ["k"]), "summary": validate.summary(rows, ["k"])}


def compare_aggregated(a: DataFrame, b: DataFrame, least: int = 1) -> dict[str, DataFrame]:
    pairs = sites.paired(a, b, least)
    return {"coverage_a": sites.coverage_histogram(a), "coverage_b": sites.coverage_histogram(b), "metrics": sites.comparison(pairs), "histogram": sites.histogram_2d(pairs)}


def create_motif_bed(contigs: DataFrame, motifs: list[tuple[str, int]]) -> DataFrame:
    check_motifs(motifs)
    out = merge_all([sites.motif_sites(contigs, m, at) for m, at in motifs]).distinct()
    return out.orderBy(natural_key("chrom"), "chrom", "pos", "strand")


def merge_haploid(diploid: DataFrame, hap1: DataFrame, hap2: DataFrame, force: bool = False) -> DataFrame:
    if not force and any(variants.unmatched_haploid(diploid, h).limit(1).count() for h in (hap1, hap2)):
        raise ValueError("haploid calls that the diploid source lacks")
    return variants.merge_haploid_calls(diploid, hap1, hap2)


def heterozygous_factor(calls: DataFrame, truth: DataFrame, diploid_calls: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame | dict[str, DataFrame]:
    """Scores of called genotypes by class; with diploid calls made at a factor of 1 and the loci's kinds and truth, also the sweep over all factors and its best ones."""
    scores = variants.confusion_scores(variants.split_genotype_counts(calls, truth))
    if diploid_calls is None:
        return scores
    sweep = variants.factor_sweep(variants.factor_breaks(diploid_calls, kinds))
    return {"scores": scores, "sweep": sweep, "best": variants.best_factors(sweep)}


COMMANDS: dict[str, Callable | None] = {
    "aggregate run": aggregate_run,
    "calibrate modified_bases": calibrate.fit,
    "calibrate variants": calibrate.fit_variants,
    "calibrate generate_modified_base_stats": generate_mod_stats,
    "calibrate generate_mod_stats_from_msf": None,
    "calibrate generate_variant_stats": reads.candidate_changes,
    "calibrate merge_modified_bases": lambda tables: sites.first_listed(tables, "mod_base"),
    "calibrate merge_modified_bases_stats": merge_all,
    "merge modified_bases": lambda tables: sites.merge_per_read(tables, ["chrm", "pos", "strand"]),
    "merge aggregated_modified_bases": lambda tables: sites.in_genome_order(sites.merge(tables)),
    "merge variants": merge_variants,
    "modified_bases describe_alphabet": split_alphabet,
    "modified_bases estimate_threshold": mods.global_threshold,
    "modified_bases update_database": None,
    "modified_bases create_ground_truth": lambda records, strand_offset=None, **o: sites.ground_truth(sites.sum_records(records, strand_offset), strand_offset=strand_offset, **o),
    "modified_bases create_motif_bed": create_motif_bed,
    "modified_bases per_site_thresholds": mods.per_site_thresholds,
    "modified_bases index_database": index_by_position,
    "modified_bases split_by_motif": sites.split_by_motif,
    "phase_variants whatshap_filter": whatshap_filter,
    "phase_variants extract_haplotype_reads": variants.split_haplotypes,
    "phase_variants merge_haploid_variants": merge_haploid,
    "per_read_text modified_bases": text.per_read_mods,
    "per_read_text variants": text.per_read_variants,
    "validate results": validate_results,
    "validate aggregated_modified_bases": validate_aggregated,
    "validate compare_modified_bases": compare_aggregated,
    "validate modified_bases calibration": validate_results,
    "variants atomize": variants.atomize,
    "variants resolve": resolve.resolve,
    "variants heterozygous_factor": heterozygous_factor,
    "variants index_database": None,
}
