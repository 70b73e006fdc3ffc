"""A main run over tables: settings say which outputs are made, how, and of which reads.

Inputs are DataFrames: ``alignments`` (read_id, chrm, pos, strand, mapq, cigar, seq, qual, tags, map_num, ref_seq), ``mod_calls`` (chrm, pos, strand, read_id,
mod_base, score), ``var_calls`` (contig, pos, ref_seq, alt_seq, read_id, score) and ``contigs`` (chrm, chrm_len, number). Each output is a folder of that name.
Reads whose first mapping does not pass go to ``rejected`` with the reason, and no output has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import mods, reads, variants
from strandlake.plans.settings import RunSettings
from strandlake.session import discard, materialize
from strandlake.sources import text
from strandlake.streaming import reporting

#: Outputs that tables can give; the others need signal, a base caller or an aligner.
POSSIBLE = {"mappings", "per_read_refs", "per_read_mods", "mods", "per_read_variants", "variants"}
NEEDS = {"mappings": ("alignments", "contigs"), "per_read_refs": ("alignments",), "per_read_mods": ("alignments", "mod_calls"), "mods": ("alignments", "mod_calls"), "per_read_variants": ("alignments", "var_calls"), "variants": ("alignments", "var_calls", "contigs")}
LOCUS = ["contig", "pos", "ref_seq"]


def rules(settings: RunSettings) -> dict[str, Column]:
    """What a read's first mapping has to fulfil, by the name of the reason if it does not. Bounds left out do not filter."""
    low, high = settings.ref_length_range
    length = F.col("num_align") - F.col("num_ins")
    every = [("reference too short", low, lambda b: length >= b), ("reference too long", high, lambda b: length <= b), ("identity", settings.percent_identity, lambda b: F.col("pct_identity") >= b), ("coverage", settings.percent_coverage, lambda b: F.col("read_pct_coverage") >= b)]
    return {name: good(bound) for name, bound, good in every if bound is not None}


def check(settings: RunSettings, given: dict[str, DataFrame | None]) -> None:
    """An error for outputs that tables cannot give, or whose tables are not there."""
    if outside := sorted(set(settings.resolved) - POSSIBLE):
        raise ValueError(f"outputs that tables cannot give: {outside}")
    for output in settings.resolved:
        if lacking := [n for n in NEEDS[output] if given.get(n) is None]:
            raise ValueError(f"{output} needs {lacking}")


def site_calls(calls: DataFrame, settings: RunSettings) -> DataFrame:
    """Site calls by the settings' method, with the columns that all formats know."""
    options = {"threshold": settings.mod_binary_threshold} if settings.mod_aggregate_method == "binary_threshold" else {}
    out = mods.aggregate(calls, settings.mod_aggregate_method, **options)
    return out if "valid_reads" in out.columns else out.withColumn("valid_reads", F.col("reads"))


def genotype_calls(calls: DataFrame, settings: RunSettings) -> DataFrame:
    """Genotypes by locus in the columns of :func:`text.vcf_lines`."""
    if settings.haploid:
        out = variants.haploid(calls, LOCUS).withColumn("genotypes", F.transform(F.sequence(F.lit(0), F.size("alleles") - 1), lambda i: i.cast("string")))
    else:
        out = variants.diploid(calls, settings.heterozygous_factors, LOCUS)
    return out.withColumns({"ref": F.col("ref_seq"), "alts": F.slice("alleles", 2, F.size("alleles"))})


def run(settings: RunSettings, out: str, alignments: DataFrame, mod_calls: DataFrame | None = None, var_calls: DataFrame | None = None, contigs: DataFrame | None = None) -> dict[str, int]:
    """Write the outputs and return the numbers of reads: all, good, and by reason of rejection."""
    check(settings, {"alignments": alignments, "mod_calls": mod_calls, "var_calls": var_calls, "contigs": contigs})
    own = rules(settings)
    first = reads.alignment_summary(alignments.where("map_num = 0"))
    if settings.num_reads is not None:
        first = first.join(first.select("read_id").distinct().orderBy("read_id").limit(settings.num_reads), "read_id", "left_semi")
    marked = materialize(reporting.mark(first, own), "reads")
    counts = reporting.named(marked.agg(*reporting.counters(own)).first().asDict(), own)
    marked.where("reason is not null").write.parquet(f"{out}/rejected")
    good = marked.where("reason is null").drop("reason").withColumn("r_st", F.col("pos")).withColumn("r_en", F.col("pos") + F.col("num_align") - F.col("num_ins"))
    wanted = set(settings.resolved)
    if "mappings" in wanted:
        kept = alignments.join(good.select("read_id").distinct(), "read_id", "left_semi")
        text.write_ordered(text.sam_file(kept, contigs), ["part", "number", "pos", "value"], f"{out}/mappings")
    if "per_read_refs" in wanted:
        text.read_references(good).write.text(f"{out}/per_read_refs")
    if "per_read_mods" in wanted:
        calls = mods.edge_buffer(mod_calls, good, settings.edge_buffer) if settings.edge_buffer else mod_calls.join(good.select("read_id").distinct(), "read_id", "left_semi")
        calls = calls.where(F.exp("score") >= settings.mod_min_prob).select("chrm", "pos", "strand", "read_id", "mod_base", "score")
        calls.repartitionByRange("chrm", "pos").sortWithinPartitions("chrm", "pos", "strand", "read_id").write.parquet(f"{out}/per_read_mods")
    if "mods" in wanted:
        sites = materialize(site_calls(marked.sparkSession.read.parquet(f"{out}/per_read_mods"), settings), "sites")
        for form in settings.mod_output_formats:
            if form == "bedmethyl":
                text.write_by_mod(text.bed_methyl_lines(sites), f"{out}/mods/bedmethyl")
            elif form == "wiggle":
                text.write_ordered(text.wiggle_files(sites), text.in_file_order(), f"{out}/mods/wiggle", "file")
            else:
                text.write_ordered(text.mod_vcf_lines(sites), ["chrm", "pos", "value"], f"{out}/mods/modvcf")
        discard(sites)
    if "per_read_variants" in wanted:
        calls = var_calls.withColumn("chrm", F.col("contig"))
        calls = mods.edge_buffer(calls, good, settings.edge_buffer, variants=True) if settings.edge_buffer else calls.join(good.select("read_id").distinct(), "read_id", "left_semi")
        calls = calls.where(F.abs(F.length("alt_seq") - F.length("ref_seq")) <= settings.max_indel_size).select("contig", "pos", "ref_seq", "alt_seq", "read_id", "score")
        calls.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos", "read_id").write.parquet(f"{out}/per_read_variants")
    if "variants" in wanted:
        called = genotype_calls(marked.sparkSession.read.parquet(f"{out}/per_read_variants"), settings)
        # A genome has few contigs: their lines are the size of a header.
        names = [(r["chrm"], r["chrm_len"]) for r in contigs.orderBy("number").collect()]
        text.write_ordered(text.vcf_file(text.vcf_lines(called), names), ["part", "number", "contig", "pos", "value"], f"{out}/variants")
    discard(marked)
    return counts
