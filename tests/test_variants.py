import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import expr
from strandlake.operators import intervals, variants

LN = math.log


def lse(v):
    m = max(v)
    return m if m == -math.inf else m + LN(sum(math.exp(x - m) for x in v))


def loop_diploid(reads, het=1.0):
    """reads: [[lp of each allele]], reference first."""
    n, k = len(reads), len(reads[0])
    out = []
    for a, b in variants.genotype_order(k):
        if a == b:
            out.append(sum(r[a] for r in reads) + n * LN(het))
            continue
        order = sorted(reads, key=lambda r: r[b] - r[a])
        out.append(lse([LN(math.comb(n, i)) - n * LN(2) + sum(r[a] for r in order[:i]) + sum(r[b] for r in order[i:]) for i in range(n + 1)]))
    z = lse(out)
    return [x - z for x in out]


@pytest.mark.parametrize("het", [1.0, 0.85])
def test_diploid_matches_a_loop(spark, het):
    random.seed(2)
    rows, want = [], {}
    for locus, n in enumerate([1, 2, 3, 7, 12]):
        reads = []
        for i in range(n):
            p = [random.random() + 0.01 for _ in range(3)]
            p = [x / sum(p) for x in p]
            rows += [(locus, i, "A", LN(p[1])), (locus, i, "T", LN(p[2]))]
            reads.append([LN(1 - p[1] - p[2]), LN(p[1]), LN(p[2])])
        want[locus] = loop_diploid(reads, het)
    rows += [(50, 1, "A", -1.0), (50, 1, "T", -2.0), (50, 2, "A", -1.0)]  # a read lacks an alternative
    out = variants.diploid(spark.createDataFrame(rows, "locus long, read_id long, alt_seq string, score double"), het).collect()
    assert {r["locus"] for r in out} == set(want)
    for r in out:
        assert np.allclose(r["log_probs"], want[r["locus"]], atol=1e-9)
        assert r["genotypes"] == ["0/0", "0/1", "1/1", "0/2", "1/2", "2/2"] and math.isclose(sum(map(math.exp, r["log_probs"])), 1)


def test_haploid_and_fields(spark):
    rows = [(1, i, "A", LN(0.1)) for i in range(3)]
    r = variants.haploid(spark.createDataFrame(rows, "locus long, read_id long, alt_seq string, score double")).first()
    a, b = 3 * LN(0.9), 3 * LN(0.1)
    assert np.allclose(r["log_probs"], [a - lse([a, b]), b - lse([a, b])]) and r["gt"] == 0 and r["alleles"] == ["ref", "A"]
    f = spark.range(1).select(expr.genotype_fields(F.array(F.lit(LN(0.001)), F.lit(LN(0.9)), F.lit(-5000.0))).alias("f")).first()["f"]
    assert f["best"] == 1 and f["pl"] == [30, 0, 999] and f["gq"] == 30 and f["qual"] == 30 and f["gl"][2] == -999.0


def test_atoms_merge_and_context(spark):
    v = spark.createDataFrame([("c", 10, "ACG", ["TCA", "AG"], "x"), ("c", 10, "A", ["T"], "y"), ("c", 5, "A", ["A"], "same")], "contig string, pos long, ref string, alts array<string>, id string")
    got = sorted(map(tuple, variants.atomize(v).collect()))
    assert got == [("c", 10, "A", "T", "x;y"), ("c", 11, "C", "", "x"), ("c", 12, "G", "A", "x")]
    merged = {(r["pos"], r["ref"]): (r["alts"], r["ids"]) for r in variants.merge_alleles(variants.atomize(v)).collect()}
    assert merged[10, "A"] == (["T"], "x;y")
    contigs = spark.createDataFrame([("c", "GGGGGGGGGGTACGT")], "contig string, seq string")
    atoms = variants.merge_alleles(variants.atomize(v)).where("ref = 'C'")
    r = variants.add_context_base(atoms, contigs).first()
    assert (r["pos"], r["ref"], r["alts"]) == (10, "TC", ["T"])
    bad = variants.check_reference(spark.createDataFrame([("c", 0, "G"), ("c", 0, "T"), ("d", 0, "G")], "contig string, pos long, ref string"), contigs)
    assert sorted((r["contig"], r["ref"]) for r in bad.collect()) == [("c", "T"), ("d", "G")]


def test_indels_expand_over_repeats(spark):
    seq = "CCATATATGG"
    assert variants.expand_indel(seq, 4, "AT", "") == (2, "ATATAT", "ATAT")
    assert variants.expand_indel(seq, 4, "", "AT") == (2, "ATATAT", "ATATATAT")
    assert variants.expand_indel(seq, 4, "A", "T") == (4, "A", "T")
    assert variants.expand_indel("AAAA", 1, "A", "") is None
    for pos, (ref, alt) in itertools.product(range(2, 7), [("AT", ""), ("", "TA")]):
        if ref and seq[pos : pos + 2] != ref:
            continue
        p, r, a = variants.expand_indel(seq, pos, ref, alt)
        assert seq[:p] + a + seq[p + len(r) :] == seq[:pos] + alt + seq[pos + len(ref) :] and seq[p : p + len(r)] == r
    df = spark.createDataFrame([("c", 4, "AT", "")], "contig string, pos long, ref string, alt string")
    assert tuple(variants.expand_indels(df, spark.createDataFrame([("c", seq)], "contig string, seq string")).first()) == ("c", 2, "ATATAT", "ATAT")


def test_phased_merge_and_unmatched(spark):
    schema = "contig string, pos long, ref string, alt string, gl array<double>"
    d = spark.createDataFrame([("c", i, "A", "G", g) for i, g in enumerate([[-3.0, 0.0, -3.0], [0.0, -3.0, -9.0], [-9.0, -1.0, 0.0], [-3.0, 0.0, -2.0]])], schema)
    h1 = spark.createDataFrame([("c", 0, "A", "G", [0.0, -4.0]), ("c", 9, "A", "G", [0.0, -1.0])], schema)
    h2 = spark.createDataFrame([("c", 0, "A", "G", [-4.0, 0.0])], schema)
    assert {r["pos"]: r["gt"] for r in variants.merge_haploid_calls(d, h1, h2).collect()} == {0: "0|1", 1: "0/0", 2: "1/1", 3: "1/1"}
    assert [r["pos"] for r in variants.unmatched_haploid(d, h1).collect()] == [9]


def test_confusion_scores_are_null_where_undefined(spark):
    t = spark.createDataFrame([("c", i, "A", "G", "0/1") for i in range(3)], "contig string, pos long, ref string, alt string, gt string")
    rows = {r["class"]: r for r in variants.confusion_scores(variants.split_genotype_counts(t, t)).collect()}
    assert rows["het"]["f1"] == 1.0 and rows["hom_alt"]["precision"] is None


def loop_fold(rows):
    out = []
    for r in sorted(rows):
        if not out or r[0] >= out[-1][1]:
            out.append(r)
        elif r[3] > out[-1][3]:
            out[-1] = r
    return sorted(out)


def test_interval_operators_match_loops(spark):
    random.seed(9)
    rows = [(random.randrange(300), 0, i, float(random.randrange(5))) for i in range(120)]
    rows = [(s, s + 1 + random.randrange(12), i, q) for s, _, i, q in rows]
    df = spark.createDataFrame([("c", *r) for r in rows], "contig string, start long, end long, id long, qual double")
    got = sorted((r["start"], r["end"], r["id"], r["qual"]) for r in intervals.resolve_overlaps(df, ["contig"], "qual", "id").collect())
    assert got == loop_fold(rows)
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    for width in (3, 10, 1000):
        pairs = sorted((r["id"], r["b_id"]) for r in intervals.overlaps(a, b, ["contig"], width).collect())
        assert pairs == sorted((x[2], y[2]) for x in rows for y in rows if x[2] % 2 == 0 and y[2] % 2 == 1 and x[0] < y[1] and y[0] < x[1])
    near = sorted((r["id"], r["b_id"]) for r in intervals.band_pairs(df, ["contig"], "start", "end", 5, "id").collect())
    assert near == sorted((x[2], y[2]) for x in rows for y in rows if 0 <= y[0] - x[1] <= 5)
    points = spark.createDataFrame([("c", p) for p in range(0, 320, 7)], "contig string, pos long")
    hit = sorted((r["id"], r["pos"]) for r in intervals.points_in_intervals(df, points, ["contig"], "start", "end", "pos", 5).collect())
    assert hit == sorted((x[2], p) for x in rows for p in range(0, 320, 7) if x[0] <= p < x[1])
    chain = spark.createDataFrame([("c", 0, 10, 1, 1.0), ("c", 8, 20, 2, 5.0), ("c", 18, 30, 3, 3.0), ("c", 30, 40, 4, 0.0)], df.schema)
    best = {r["id"]: r["members"] for r in intervals.best_of_islands(chain, ["contig"], "qual", "id").collect()}
    assert best == {2: 3, 4: 1}


def test_haploid_joins_nothing_and_leaves_incomplete_loci_out(spark):
    rows = [(1, 1, "A", -1.0), (1, 1, "T", -2.0), (1, 2, "A", -1.5), (1, 2, "T", -1.5), (2, 1, "A", -1.0), (2, 1, "T", -2.0), (2, 2, "A", -1.0), (None, 1, "A", -1.0)]
    out = variants.haploid(spark.createDataFrame(rows, "locus long, read_id long, alt_seq string, score double"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    (r,) = out.collect()
    assert (r["locus"], r["reads"], r["alleles"]) == (1, 2, ["ref", "A", "T"])


def test_reads_of_loci_are_dealt_by_pairs_of_alleles(spark, monkeypatch):
    """Reads of 40 loci with three alternatives, six pairs of alleles each, go to as many shares as those ask for."""
    from strandlake.session import deal

    monkeypatch.setattr(variants, "deal", lambda df, *keys, rows: deal(df, *keys, rows=rows, share=10))
    calls = spark.range(600).selectExpr("id % 40 as locus", "id div 120 as read_id", "element_at(array('A', 'G', 'T'), cast(id div 40 % 3 as int) + 1) as alt_seq", "-2.0D as score").coalesce(1)
    reads = variants.complete_reads(calls)
    assert reads.count() == 200 and reads.rdd.getNumPartitions() == 120
