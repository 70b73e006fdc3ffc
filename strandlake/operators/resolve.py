"""Resolving variant calls of one or both strands into records that do not overlap.

Rows: contig, pos, id, ref, alts, gt, gl (log10 of each genotype), dp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.expr import homopolymer_length, round_half_even, trim_padding_all
from strandlake.operators.intervals import overlaps, resolve_overlaps

#: Bounds of the written fields.
LEAST_GL, MOST_PL = -999.0, 999.0


def likeliest_of_overlapping(calls: DataFrame) -> DataFrame:
    """Of calls that overlap, in order, the ones whose reference is least likely. Equal rows count once."""
    name = F.concat_ws("|", "ref", F.array_join("alts", ","), F.coalesce(F.col("id").cast("string"), F.lit(".")))
    rows = calls.withColumn("_name", name).dropDuplicates(["contig", "pos", "_name"])
    spans = rows.select("contig", F.col("pos").alias("start"), (F.col("pos") + F.length("ref")).alias("end"), "_name", (-F.pow(F.lit(10.0), F.col("gl")[0])).alias("_score"))
    kept = resolve_overlaps(spans, ["contig"], "_score", "_name").select("contig", F.col("start").alias("pos"), "_name")
    return rows.join(kept, ["contig", "pos", "_name"], "left_semi")


def passing(calls: DataFrame, most_ratio: float, least_depth: int | None) -> DataFrame:
    """Calls deep enough whose reference is at most ``most_ratio`` times as likely as the best other genotype."""
    p = F.transform("gl", lambda x: F.pow(F.lit(10.0), x))
    best = F.array_max(F.slice(p, F.lit(2), F.size("gl")))
    out = calls.where((best > 0) & (F.try_divide(F.get(p, F.lit(0)), best) <= most_ratio))
    return out if least_depth is None else out.where(F.col("dp") >= least_depth)


def _genotype(index: Column, diploid: Column) -> Column:
    """Alleles of the genotype with this number: itself if haploid, else the pair in VCF order."""
    second = F.floor((F.sqrt(8.0 * index + 1) - 1) / 2).cast("int")
    first = (index - second * (second + 1) / 2).cast("int")
    return F.when(diploid, F.array(first, second)).otherwise(F.array(index, index))


def with_best_alternative(calls: DataFrame) -> DataFrame:
    """Each call with the alternatives of its likeliest non-reference genotype only, and gt, gl, pl, gq, qual made again from that and the reference."""
    others = F.slice("gl", F.lit(2), F.size("gl"))
    x = calls.withColumn("_g", F.array_position(others, F.array_max(others)).cast("int")).withColumn("_sep", F.regexp_extract("gt", "[/|]", 0))
    two = F.col("_sep") != ""
    x = x.withColumn("_alleles", _genotype(F.col("_g"), two))
    x = x.withColumn("_kept", F.array_sort(F.array_distinct(F.filter("_alleles", lambda a: a > 0))))
    number = lambda k: F.when(F.col("_alleles")[k] == 0, 0).otherwise(F.array_position("_kept", F.col("_alleles")[k])).cast("string")
    other_gt = F.when(two, F.concat(number(0), "_sep", number(1))).otherwise(number(0))
    p0, p1 = (F.pow(F.lit(10.0), v) for v in (F.col("gl")[0], F.get("gl", F.col("_g"))))
    x = x.withColumn("_p", F.array(p0 / (p0 + p1), p1 / (p0 + p1)))
    gl = F.transform("_p", lambda v: F.when(v > 0, F.greatest(F.log10(v), F.lit(LEAST_GL))).otherwise(LEAST_GL))
    x = x.withColumn("_gl", gl).withColumn("_raw", F.transform("_gl", lambda v: -10 * v))
    pl = F.transform("_raw", lambda v: F.rint(F.least(v - F.array_min("_raw"), F.lit(MOST_PL))).cast("int"))
    return x.select(
        "contig", "pos", "id", "ref", F.transform("_kept", lambda a: F.get("alts", a - 1)).alias("alts"),
        F.when(F.col("_p")[0] > 0.5, F.when(two, F.concat(F.lit("0"), "_sep", F.lit("0"))).otherwise("0")).otherwise(other_gt).alias("gt"),
        F.transform("_gl", lambda v: round_half_even(v, 2) + F.lit(0.0)).alias("gl"), pl.alias("pl"), F.array_max(pl).alias("gq"), F.rint(F.least(F.col("_raw")[0], F.lit(MOST_PL))).cast("int").alias("qual"), "dp",
    )


def resolve(forward: DataFrame, reverse: DataFrame | None = None, most_ratio: float = 1.0, least_depth: int | None = None, homopolymer: int = 4, keep_homopolymers: bool = True, trim: bool = False) -> DataFrame:
    """contig, pos, id, ref, alts, gt, gl, pl, gq, qual, dp, strand.

    Each strand's calls are resolved among themselves. With two strands, a call that meets none of the other
    strand (touching counts as meeting) keeps its own strand, 1 or -1. Where calls of both strands meet, evidence is of both: the forward one stays, without
    strand, if an allele of it has a run of ``homopolymer`` equal bases, and else neither does.
    """
    sides = [with_best_alternative(passing(likeliest_of_overlapping(x), most_ratio, least_depth)) for x in (forward, reverse) if x is not None]
    if reverse is None:
        out = sides[0].withColumn("strand", F.lit(None).cast("int"))
    else:
        key = ["contig", "pos", "ref"]
        f, r = (x.select(*key, F.col("pos").alias("start"), (F.col("pos") + F.length("ref") + 1).alias("end")) for x in sides)
        pairs = overlaps(f, r, ["contig"])
        met = pairs.select(*key).distinct(), pairs.select("contig", F.col("b_pos").alias("pos"), F.col("b_ref").alias("ref")).distinct()
        alone = [x.join(m, key, "left_anti").withColumn("strand", F.lit(s)) for x, m, s in zip(sides, met, (1, -1), strict=True)]
        out = alone[0].unionByName(alone[1])
        if keep_homopolymers:
            longest = F.greatest(homopolymer_length("ref"), F.array_max(F.transform("alts", homopolymer_length)))
            both = sides[0].join(met[0], key, "left_semi").where(longest >= homopolymer)
            out = out.unionByName(both.withColumn("strand", F.lit(None).cast("int")))
    if trim:
        t = trim_padding_all("ref", "alts")
        out = out.withColumn("_t", t).withColumns({"pos": F.col("pos") + F.col("_t")["before"], "ref": F.col("_t")["ref"], "alts": F.col("_t")["alts"]}).drop("_t")
    return out
