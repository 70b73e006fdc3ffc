"""Validation of calls: curves, scores, accuracy summaries, error counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.prefix import exact_quantiles, running, score_buckets


def clean_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """Without NaN; infinities become the largest and least finite scores."""
    x = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    finite = F.when(~F.col(score).isin(float("inf"), float("-inf")), F.col(score))
    b = x.agg(F.max(finite).alias("_hi"), F.min(finite).alias("_lo"))
    return x.crossJoin(F.broadcast(b)).withColumn(score, F.greatest(F.least(score, "_hi"), "_lo")).drop("_hi", "_lo")  # one row


def balanced(rows: DataFrame, by: list[str], label: str, identity: str, buckets: int = 1024) -> DataFrame:
    """As many of each class within ``by``: the first in order of a hash of ``identity``."""
    n = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.min("n").alias("_least"))
    hashed = rows.withColumn("_h", F.xxhash64(identity))
    share = F.shiftright("_h", 64 - (buckets.bit_length() - 1))
    placed = running(hashed, [*by, label], ["_h", identity], share, {"_n": F.lit(1)})
    return placed.join(n, by).where("_n < _least").select(*rows.columns)


def threshold_counts(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by, score, tp, fp, dp, dn, p, n at each distinct score, scores at or above it counting as positive; dp and dn are its own.

    Rows collapse to distinct scores first, and those are summed up in buckets of the score.
    """
    steps = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("dp"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("dn"))
    whole = steps.groupBy(*by).agg(F.sum("dp").alias("p"), F.sum("dn").alias("n"))
    above = running(steps, by, [F.desc(score)], -score_buckets(rows, score), {"tp": F.col("dp"), "fp": F.col("dn")})
    return above.join(whole, by).select(*by, score, (F.col("tp") + F.col("dp")).alias("tp"), (F.col("fp") + F.col("dn")).alias("fp"), "dp", "dn", "p", "n")


def _rates(t: DataFrame, by: list[str], score: str) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    precision, recall = tp / (tp + fp), F.try_divide(tp, F.col("p"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    before = (F.coalesce(F.try_divide(tp - F.col("dp"), F.col("p")), F.lit(0.0)), F.coalesce(F.try_divide(fp - F.col("dn"), F.col("n")), F.lit(0.0)))
    return t.select(*by, score, precision.alias("precision"), recall.alias("recall"), F.try_divide(fp, F.col("n")).alias("fpr"), f1.alias("f1"), before[0].alias("_recall"), before[1].alias("_fpr"), "p", "n")


def curve(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by, score, precision, recall, fpr, f1 at each distinct score."""
    return _rates(threshold_counts(rows, by, label, score), by, score).select(*by, score, "precision", "recall", "fpr", "f1")


def summary(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by, positives, negatives, ap, auc (trapezoid), best_f1, best_threshold (the first best)."""
    x = _rates(threshold_counts(rows, by, label, score), by, score)
    ap, auc = (F.col("recall") - F.col("_recall")) * F.col("precision"), (F.col("fpr") - F.col("_fpr")) * (F.col("recall") + F.col("_recall")) / 2
    best = F.max_by(F.col(score), F.struct("f1", score))
    return x.groupBy(*by).agg(F.max("p").alias("positives"), F.max("n").alias("negatives"), F.sum(ap).alias("ap"), F.sum(auc).alias("auc"), F.max("f1").alias("best_f1"), best.alias("best_threshold"))


def accuracy_summary(reads: DataFrame, by: list[str]) -> DataFrame:
    """by, reads, median, mean and mode of pct_identity (one decimal, smallest of equals), parsimonious accuracy, aligned length.

    Parsimonious accuracy: all matches of all aligned bases.
    """
    one = F.rint(F.col("pct_identity") * 10) / 10
    counts = reads.groupBy(*by, one.alias("acc")).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy(*by).agg(F.max_by("acc", F.struct("n", -F.col("acc"))).alias("mode_acc"))
    out = reads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reads"), F.avg("pct_identity").alias("mean_acc"), (100.0 * F.sum("num_match") / F.sum("num_align")).alias("parsimonious_acc"), F.sum("num_align").alias("aligned")
    )
    median = exact_quantiles(reads, by, "pct_identity", 0.5).select(*by, F.col("value").alias("median_acc"))
    return out.join(median, by, "left").join(mode, by)


def most_common_errors(errors: DataFrame, k: int, total: int) -> DataFrame:
    """The k most common messages, their number and share of reads."""
    n = errors.groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "message").limit(k).withColumn("pct", 100.0 * F.col("n") / total)
