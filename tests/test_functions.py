import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import expr


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    assert one(spark, expr.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, expr.reverse_complement(expr.reverse_complement(F.lit("ACGTTN")))) == "ACGTTN"
    assert one(spark, expr.rna_to_dna(F.lit("ACU"))) == "ACT"
    assert one(spark, expr.motif_positions(F.lit("AAAA"), "AA")) == [0, 1, 2]
    assert one(spark, expr.motif_positions(F.lit("CCAGGCCTGG"), "CCWGG", 1)) == [1, 6]
    assert one(spark, expr.motif_positions(F.lit("A"), "CG")) == []
    assert expr.motif_complement("CHG") == "CDG" and expr.motif_regex("CHG") == "(?=(C[ACT]G))"
    assert [one(spark, expr.homopolymer_length(F.lit(s))) for s in ("", "A", "ACCCGG")] == [0, 1, 3]
    t = one(spark, expr.trim_alleles(F.lit("ATTC"), F.lit("ATC")))
    assert (t["ref"], t["alt"], t["before"], t["after"]) == ("T", "", 2, 1)
    t = one(spark, expr.trim_alleles(F.lit("A"), F.lit("A")))
    assert (t["ref"], t["alt"]) == ("", "")


def test_probability_edges(spark):
    inf = float("inf")
    assert one(spark, expr.log1m(F.lit(1.0))) == -inf and math.isnan(one(spark, expr.log1m(F.lit(1.1)))) and math.isclose(one(spark, expr.log1m(F.lit(0.25))), math.log(0.75))
    assert one(spark, expr.safe_ln(F.lit(0.0))) == -inf and math.isnan(one(spark, expr.safe_ln(F.lit(-1.0))))
    assert one(spark, expr.phred(F.lit(0.0))) == inf and math.isclose(one(spark, expr.phred(F.lit(math.log(0.9)))), 10)
    v = F.array(F.lit(-1000.0), F.lit(-1001.0))
    assert math.isclose(one(spark, expr.logsumexp(v)), -1000 + math.log1p(math.exp(-1)))
    assert math.isclose(sum(one(spark, expr.softmax(v))), 1)
    assert one(spark, expr.logsumexp(F.array(F.lit(-inf), F.lit(-inf)))) == -inf
    lp = one(spark, expr.llrs_to_log_probs(F.array(F.lit(0.3), F.lit(-2.0))))
    assert math.isclose(sum(map(math.exp, lp)), 1) and math.isclose(lp[0] - lp[1], 0.3)
    assert [one(spark, expr.round_half_even(F.lit(x), 1)) for x in (0.25, 0.35, 2.05)] == [np.round(x * 10) / 10 for x in (0.25, 0.35, 2.05)]
    assert math.isclose(one(spark, expr.mean_qscore(F.lit("!+5"))), (0 + 10 + 20) / 3) and one(spark, expr.mean_qscore(F.lit(""))) is None


def test_arrays(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 5, 2, 8)])
    m = one(spark, expr.med_mad(v))
    assert m["med"] == 3.5 and math.isclose(m["mad"], np.median(np.abs(np.array([1, 5, 2, 8]) - 3.5)) * 1.4826)
    assert one(spark, expr.rolling_windows(v, 3)) == [[1, 5, 2], [5, 2, 8]] and one(spark, expr.rolling_windows(v, 9)) == []
    runs = one(spark, expr.run_lengths(F.split(F.lit("AAGGGA"), "")))
    assert [(r["value"], r["n"]) for r in runs] == [("A", 2), ("G", 3), ("A", 1)]
    assert math.isclose(one(spark, expr.normalise_signal(v))[1], 1.5 / m["mad"])


def test_alignments(spark):
    ops = expr.cigar_ops(F.lit("2S3M1I2D4=1X2H"))
    got = [(o["len"], o["op"]) for o in one(spark, ops)]
    assert got == [(2, "S"), (3, "M"), (1, "I"), (2, "D"), (4, "="), (1, "X"), (2, "H")]
    assert math.isclose(one(spark, expr.percent_identity(ops)), 100 * 7 / 11)
    assert one(spark, expr.reference_to_query(ops)) == [0, 1, 2, 4, 4, 4, 5, 6, 7, 8, 9]
    assert one(spark, expr.sam_flag(F.lit(-1), F.lit(True))) == 2064


def test_records(spark):
    assert [one(spark, expr.strand_to_text(F.lit(s))) for s in (1, -1, None)] == ["+", "-", "."]
    assert one(spark, expr.text_to_bool(F.lit("Yes"))) is True and one(spark, expr.text_to_bool(F.lit("off"))) is False
    with pytest.raises(Exception, match="truth"):
        one(spark, expr.text_to_bool(F.lit("maybe")))
    names = ["chr10", "chr2", "chrX", "chr1", "chr002", "a1b10", "a1b9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(expr.natural_key("n"), "n").collect()] == ["a1b9", "a1b10", "chr1", "chr002", "chr2", "chr10", "chrX"]
    assert one(spark, expr.info_map(F.lit("DP=3;DB;AF=.5"))) == {"DP": "3", "DB": None, "AF": ".5"}
    assert one(spark, expr.format_map(F.lit("GT:GQ"), F.lit("0/1:9"))) == {"GT": "0/1", "GQ": "9"}
    assert one(spark, expr.seconds_text(F.lit(1), F.lit(4000.0))) == "0.000250"
