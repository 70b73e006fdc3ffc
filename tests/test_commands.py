import math

import numpy as np
import pytest

from strandlake.functions import kernels as k
from strandlake.operators import calling
from strandlake.plans import commands, settings

R = np.random.default_rng(8)


def test_all_commands_are_there():
    assert len(commands.COMMANDS) == 32 and sum(f is None for f in commands.COMMANDS.values()) == 3


def test_settings():
    s = settings.RunSettings(outputs=("mods", "variants"))
    assert s.resolved == ("per_read_variants", "variants", "per_read_mods", "mods")
    with pytest.raises(ValueError):
        settings.RunSettings(outputs=("variants",), rna=True)
    with pytest.raises(ValueError):
        settings.RunSettings(outputs=("nothing",))
    settings.check_motifs([("CG", 0), ("CHG", 0)])
    for bad in ([("CG", 0), ("CGG", 0)], [("CG", 2)], [("NG", 0)], [("CZ", 0)]):
        with pytest.raises(ValueError):
            settings.check_motifs(bad)
    assert settings.split_alphabet("ACmhGT", "ACCCGT") == {"A": [], "C": ["m", "h"], "G": [], "T": []}


def test_motifs_thresholds_and_truth(spark):
    contigs = spark.createDataFrame([("chr10", "ACGT"), ("chr2", "CGCG")], "chrom string, seq string")
    got = [(r["chrom"], r["pos"], r["strand"]) for r in commands.COMMANDS["modified_bases create_motif_bed"](contigs, [("CG", 0)]).collect()]
    assert got == [("chr2", 0, 1), ("chr2", 1, -1), ("chr2", 2, 1), ("chr2", 3, -1), ("chr10", 1, 1), ("chr10", 2, -1)]
    rec = spark.createDataFrame([("c", 1, 5, 10, 100.0), ("c", -1, 6, 10, 90.0), ("c", 1, 9, 10, 50.0)], "chrom string, strand int, pos long, cov long, pct double")
    t = commands.COMMANDS["modified_bases create_ground_truth"](rec, strand_offset=1)
    assert sorted(map(tuple, t.collect())) == [("c", -1, 6, True), ("c", 1, 5, True)]


def test_resolving_and_filters(spark):
    f = spark.createDataFrame([("c", 1, 4, 1, 5.0, [-5.0, 0.0]), ("c", 9, 12, 2, 1.0, [0.0, -5.0])], "contig string, start long, end long, id long, qual double, gl array<double>")
    r = spark.createDataFrame([("c", 3, 6, 3, 9.0, [-5.0, 0.0]), ("d", 3, 6, 4, 1.0, [-5.0, 0.0])], f.schema)
    assert sorted((x["contig"], x["id"]) for x in commands.resolve_variants(f, r).collect()) == [("c", 3), ("d", 4)]
    v = spark.createDataFrame([("c", 5, 1, "A", ["G"], 3.0), ("c", 5, 2, "AT", ["A"], 9.0), ("c", 20, 3, "ACGT", ["TTAA"], 99.0)], "contig string, pos long, id long, ref string, alts array<string>, qual double")
    assert [x["id"] for x in commands.whatshap_filter(v).collect()] == [2]


def test_validation_commands(spark):
    rows = [("s", "m", bool(i % 2), float((i % 2) * -4 + R.normal())) for i in range(200)] + [("s", "m", True, float("-inf"))]
    s = commands.validate_results(spark.createDataFrame(rows, "sample string, mod_base string, is_mod boolean, llr double"))["mods"].first()
    assert s["positives"] == s["negatives"] == 100 and s["auc"] > 0.95
    summed = spark.createDataFrame([("c", 1, i, 10, i) for i in range(11)], "chrom string, strand int, pos long, cov long, mod_cov long")
    truth = spark.createDataFrame([("c", 1, i, i > 5) for i in range(11)], "chrom string, strand int, pos long, is_mod boolean")
    assert commands.validate_aggregated(summed, truth)["summary"].first()["auc"] == 1.0
    assert commands.compare_aggregated(summed, summed)["metrics"].first()["rmse"] == 0


def read_table(spark, refs, strand=1):
    rows = []
    for i, ref in enumerate(refs):
        n = len(ref)
        starts = [3 * j for j in range(n + 1)]
        rows.append((i, "c", 100, strand, ref, starts, R.normal(size=(3 * n, 46)).tolist()))
    return spark.createDataFrame(rows, "read_id long, chrm string, r_st long, strand int, ref string, starts array<int>, post array<array<double>>")


def test_calls_of_mods_per_read(spark):
    model = calling.ModModel({"A": 40, "C": 41, "G": 42, "T": 43}, {"C": {"m": 44, "h": 45}})
    ref = "ATCGATTACGGA"
    reads = read_table(spark, [ref, "AANCGAA"])
    rows = calling.call_mods(reads, model, [("CG", 0)], context=3).collect()
    assert {(r["read_id"], r["pos"]) for r in rows} == {(0, 102), (0, 108)}
    post = np.array(reads.where("read_id = 0").first()["post"])
    llr = {m: k.mod_llr(post, ref[0:6], 2, c, 41, 0, 18, model.canonical) for m, c in (("h", 45), ("m", 44))}
    want = {m: -math.log1p(sum(math.exp(-x) for x in llr.values())) - v for m, v in llr.items()}
    got = {r["mod_base"]: r["score"] for r in rows if r["pos"] == 102}
    assert all(math.isclose(got[m], want[m]) for m in want) and sum(map(math.exp, got.values())) < 1
    back = calling.call_mods(read_table(spark, [ref], -1), model, [("CG", 0)], context=3).collect()
    assert {r["pos"] for r in back} == {100 + 11 - 2, 100 + 11 - 8}
    assert calling.call_mods(reads, model, [("CG", 0)], context=3, edge=2).count() == 2


def test_calls_of_variants_per_read_and_markup(spark):
    ref = "ATCGATTACGGATTGC"
    reads = read_table(spark, [ref])
    v = spark.createDataFrame([("c", 104, "A", ["G"]), ("c", 107, "A", ["T", "ACC"]), ("c", 500, "A", ["T"])], "contig string, pos long, ref string, alts array<string>")
    spanning = calling.reads_with_variants(reads, v)
    rows = calling.call_variants(spanning, snv_context=4, indel_context=6, context_distance=-1).collect()
    assert {(r["pos"], r["alt_seq"]) for r in rows} == {(104, "G"), (107, "T"), (107, "ACC")}
    post = np.array(reads.first()["post"])
    s = [k.score_sequence(post, k.encode(x), 0, 27, False) for x in ("ATCGATTAC", "ATCGGTTAC")]
    assert math.isclose(next(r["score"] for r in rows if r["pos"] == 104), s[1] - np.logaddexp(*s))
    joint = calling.call_variants(spanning, snv_context=4, indel_context=6).collect()
    assert len(joint) == 3 and all(r["score"] <= 0 for r in joint)
    calls = spark.createDataFrame([(0, "c", 104, "A", "G", math.log(0.9)), (0, "c", 107, "A", "ACC", math.log(0.8)), (0, "c", 107, "A", "T", math.log(0.1)), (0, "c", 110, "GA", "G", math.log(0.7))], "read_id long, chrm string, pos long, ref_seq string, alt_seq string, score double")
    out = calling.annotate_variants(reads, calls).first()
    assert out["seq"] == "ATCGGTTACCCGGTTGC" and out["cigar"] == "8M2I3M1D4M"


def test_markup_of_mods(spark):
    reads = read_table(spark, ["ACGC"])
    calls = spark.createDataFrame([(0, "c", 101, 1, "m", math.log(0.9)), (0, "c", 101, 1, "h", math.log(0.05)), (0, "c", 103, 1, "m", math.log(0.2))], "read_id long, chrm string, pos long, strand int, mod_base string, score double")
    out = calling.mark_mods(reads, calls).first()
    assert out["seq"] == "AmGC" and out["qual"] == "I+II"
    limits = spark.createDataFrame([("c", 103, 1, 5.0)], "chrm string, pos long, strand int, threshold double")
    assert calling.mark_mods(reads, calls, site_thresholds=limits).first()["seq"] == "AmGm"
