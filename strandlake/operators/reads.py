"""Read-level operators: enumeration, filters, alignment summaries, candidates, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.expr import alignment_stats, cigar_ops, cigar_total, percent_identity


def enumerate_reads(reads: DataFrame, allow: DataFrame | None = None, identity: str = "uuid") -> DataFrame:
    """One row a read identity: the smallest read_id and the number of copies; only listed ones where a list is given."""
    if allow is not None:
        reads = reads.join(allow, identity, "left_semi")
    return reads.groupBy(identity).agg(F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("copies")).select("read_id", identity, "copies")


def alignment_summary(alignments: DataFrame) -> DataFrame:
    """Adds num_align, num_match, num_del, num_ins, pct_identity and read_pct_coverage from ``cigar``."""
    ops = cigar_ops("cigar")
    x = alignments.withColumn("_ops", ops).withColumn("_s", alignment_stats(F.col("_ops")))
    used = cigar_total(F.col("_ops"), "MI=X")
    whole = cigar_total(F.col("_ops"), "MI=XSH")
    return x.select(*alignments.columns, "_s.*", percent_identity(F.col("_ops")).alias("pct_identity"), (100.0 * used / whole).alias("read_pct_coverage"))


def passing(summary: DataFrame, min_length: int | None = None, max_length: int | None = None, min_identity: float | None = None, min_coverage: float | None = None) -> DataFrame:
    """Alignments within the given bounds; bounds left out do not filter."""
    for column, low, high in (("num_align", min_length, max_length), ("pct_identity", min_identity, None), ("read_pct_coverage", min_coverage, None)):
        if low is not None:
            summary = summary.where(F.col(column) >= low)
        if high is not None:
            summary = summary.where(F.col(column) <= high)
    return summary


def candidate_changes(reads: DataFrame, step: int = 5, most: int = 400, longest: int = 5) -> DataFrame:
    """read_id, pos, kind, size: every ``step``-th position of a read of length n, a substitution and indels at each."""
    kinds = F.array(F.struct(F.lit("snp").alias("kind"), F.lit(1).alias("size")), *[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("size")) for k in ("del", "ins") for i in range(1, longest + 1)])
    last = F.least(F.floor((F.col("n") - 1) / step), F.lit(most - 1))
    at = reads.where("n > 0").select("read_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("_k"))
    return at.select("read_id", (F.col("_k") * step).alias("pos"), F.explode(kinds).alias("x")).select("read_id", "pos", "x.kind", "x.size")


def signal_coordinates(alignments: DataFrame) -> DataFrame:
    """map_sig_start, map_sig_end: of reversed signal (RNA) the query's ends swap and count from the other end."""
    n, s, e = F.col("sig_len"), F.col("q_sig_st"), F.col("q_sig_en")
    return alignments.withColumn("map_sig_start", F.when(F.col("reversed"), n - e).otherwise(s)).withColumn("map_sig_end", F.when(F.col("reversed"), n - s).otherwise(e))


def mod_tags(calls: DataFrame, least: float = 0.0) -> DataFrame:
    """read_id, mm, ml: skip counts among bases of the same kind, and probabilities as bytes.

    ``calls``: read_id, can_base, mod_base, ordinal (number of the base among those of its kind in the read), prob.
    """
    kept = calls.where(F.col("prob") >= least)
    item = F.array_sort(F.collect_list(F.struct("ordinal", F.least(F.floor(F.col("prob") * 256), F.lit(255)).cast("int").alias("b"))))
    per = kept.groupBy("read_id", "can_base", "mod_base").agg(item.alias("v"))
    skips = F.transform("v", lambda x, i: x["ordinal"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("v"), i - 1)["ordinal"]) - 1)
    text = F.concat("can_base", F.lit("+"), "mod_base", F.lit(","), F.array_join(F.transform(skips, lambda x: x.cast("string")), ","))
    one = per.select("read_id", F.struct("can_base", "mod_base", text.alias("t"), F.transform("v", lambda x: x["b"]).alias("b")).alias("x"))
    out = one.groupBy("read_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return out.select("read_id", F.concat(F.array_join(F.transform("x", lambda y: y["t"]), ";"), F.lit(";")).alias("mm"), F.array_join(F.transform(F.flatten(F.transform("x", lambda y: y["b"])), lambda b: b.cast("string")), ",").alias("ml"))
