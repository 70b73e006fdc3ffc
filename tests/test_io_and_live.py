import math
import threading
import time

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import calibrate, reads, sites, validate
from strandlake.sources import text
from strandlake.streaming import live


def write(path, s):
    path.write_text(s)
    return str(path)


def test_readers(spark, tmp_path):
    ids = lambda s: sorted(r["read_id"] for r in text.read_ids(spark, write(tmp_path / f"ids{abs(hash(s))}", s)).collect())
    assert ids("a\nb\na\n") == ["a", "b"] and ids("x\tread_id\n1\tq\n2\tr\n") == ["q", "r"]
    bed = write(tmp_path / "s.bed", "c\t5\t6\t.\t2\t+\nc\t5\t6\t.\t7\t+\nc\t9\t10\t.\t1\t-\nshort\t1\t2\n")
    assert sorted(map(tuple, text.bed_sites(spark, bed).collect())) == [("c", 5, 1), ("c", 9, -1)]
    scores = text.bed_scores(spark, bed)
    assert {(r["pos"], r["score"]) for r in scores.collect()} == {(5, 7.0), (9, 1.0)}
    dense = text.dense_scores(spark.createDataFrame([("c", 5, 1), ("c", 6, 1)], "chrm string, pos long, strand int"), scores)
    assert {(r["pos"], r["score"]) for r in dense.collect()} == {(5, 7.0), (6, 0.0)}
    fa = write(tmp_path / "r.fa", ">c1 note\nACG\nTT\n>c2\nGG\n")
    assert sorted(map(tuple, text.fasta(spark, fa).collect())) == [("c1", "ACGTT"), ("c2", "GG")]
    vcf = write(tmp_path / "v.vcf", "##x\n#CHROM\nc\t10\t.\tA\tG,T\t30\t.\tDP=3;DB\tGT:GQ\t0/1:9\n")
    r = text.vcf(spark, vcf).first()
    assert (r["pos"], r["alts"], r["qual"], r["info"]["DP"], r["sample"]["GT"], r["id"]) == (9, ["G", "T"], 30.0, "3", "0/1", None)
    gt = write(tmp_path / "g.csv", "c,+,4,True\nc,.,5,no\n")
    assert sorted(map(tuple, text.ground_truth(spark, gt).select("pos", "strand", "is_mod").collect())) == [(4, 1, True), (5, None, False)]


def test_bed_methyl_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("chr2", 5, 1, 9, 8, "m", 0.25), ("chr10", 1, -1, 9, 2000, "m", 1.0), ("chr2", 4, 1, 3, 0, "h", 0.0)], "chrm string, pos long, strand int, reads long, valid_reads long, mod_base string, prop double")
    text.write_by_mod(text.bed_methyl_lines(calls), str(tmp_path / "out"))
    back = text.bed_methyl(spark, str(tmp_path / "out/mod_base=m"))
    assert sorted(map(tuple, back.collect())) == [("chr10", 1, -1, 2000, 100.0), ("chr2", 5, 1, 8, 25.0)]
    lines = [r["value"] for r in text.bed_methyl_lines(calls).where("pos = 1").collect()]
    assert lines == ["chr10\t1\t2\t.\t1000\t-\t1\t2\t0,0,0\t2000\t100.0"]
    summed = {(r["chrom"], r["pos"]): (r["cov"], r["mod_cov"]) for r in sites.sum_records(back.withColumnRenamed("chrm", "chrom")).collect()}
    assert summed["chr2", 5] == (8, 2)


def test_sam_and_tags(spark):
    a = spark.createDataFrame([("r", "c", 4, -1, 60, "3M", "ACU", None, ["NM:i:0"])], "read_id string, chrm string, pos long, strand int, mapq int, cigar string, seq string, qual string, tags array<string>")
    assert text.sam_lines(a).first()["value"] == "r\t16\tc\t5\t60\t3M\t*\t0\t0\tACT\t*\tNM:i:0"
    c = spark.createDataFrame([(1, "C", "m", 0, 0.5), (1, "C", "m", 3, 1.0), (1, "C", "h", 3, 0.01)], "read_id long, can_base string, mod_base string, ordinal int, prob double")
    r = reads.mod_tags(c).first()
    assert (r["mm"], r["ml"]) == ("C+h,3;C+m,0,2;", "2,128,255")


def test_merging_is_associative(spark):
    t = [spark.createDataFrame([("c", 1, p, 4 + i, 50.0) for p in range(i, i + 3)], "chrom string, strand int, pos long, cov long, pct double") for i in range(3)]
    key = lambda df: sorted((r["pos"], r["cov"], r["mod_cov"]) for r in df.collect())
    whole = sites.merge(t)
    assert key(whole) == key(sites.merge([sites.merge(t[:2]).select(t[0].columns), t[2]]))
    lens = [spark.createDataFrame(x, "chrm string, chrm_len long") for x in ([("a", 5), ("b", 6)], [("a", 5), ("b", 7)])]
    assert [r["chrm"] for r in sites.check_contigs(lens).collect()] == ["b"]


def test_validation_cases(spark):
    rows = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.8), ("g", 1, 0.8), ("g", 0, 0.1)], "k string, label int, score double")
    s = validate.summary(rows, ["k"]).first()
    assert math.isclose(s["auc"], 0.875) and math.isclose(s["ap"], 0.5 * 1 + 0.5 * 2 / 3) and s["best_threshold"] == 0.8
    odd = spark.createDataFrame([(1, float("inf")), (0, float("-inf")), (1, 2.0), (0, 1.0), (1, float("nan"))], "label int, score double")
    assert sorted((r["label"], r["score"]) for r in validate.clean_scores(odd).collect()) == [(0, 1.0), (0, 1.0), (1, 2.0), (1, 2.0)]


def test_calibration(spark):
    r = np.random.default_rng(3)
    stats = spark.createDataFrame([("m", False, float(x)) for x in r.normal(4, 2, 1500)] + [("m", True, float(x)) for x in r.normal(-4, 2, 1500)], "mod_base string, is_mod boolean, llr double")
    d = calibrate.densities(stats, ["mod_base", "is_mod"], -20, 20, 41)
    e = calibrate.exact_densities(stats, ["mod_base", "is_mod"], -20, 20, 41)
    j = d.join(e.withColumnRenamed("density", "exact"), ["mod_base", "is_mod", "i"]).collect()
    assert len(j) > 20 and all(abs(x["density"] - x["exact"]) < 1e-4 for x in j)
    row = calibrate.fit(stats, max_llr=30.0, points=601).first()
    t = np.array(row["table"])
    assert (np.diff(t) >= -1e-9).all() and t[0] < -1 < 1 < t[-1] and row["lo"] < 0 < row["hi"]
    llrs = spark.createDataFrame([("m", x) for x in (-100.0, -1.0, -0.5, 0.0, 0.3, 1.0, 100.0)] + [("z", 5.0)], "mod_base string, llr double")
    table = spark.createDataFrame([("m", -1.0, 1.0, [10.0, 20.0, 30.0])], "mod_base string, lo double, hi double, table array<double>")
    got = {(x["mod_base"], x["llr"]): x["calibrated"] for x in calibrate.calibrate(llrs, table).collect()}
    grid = np.linspace(-1, 1, 3)
    assert all(v == (5.0 if k == "z" else [10.0, 20.0, 30.0][min(np.searchsorted(grid, x), 2)]) for (k, x), v in got.items())


def test_stream_equals_batch_and_ends_at_the_sentinel(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i * 7000, f"t{i % 3}", float(i % 100)) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "event_id long, s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    folder = tmp_path / "in"
    df.where("event_id < 100").write.parquet(str(folder))
    seen = {}

    def start(trigger):
        def keep(batch, number):
            seen["rows"] = sorted(map(tuple, batch.collect()))

        s = live.running_counts(live.source(spark, str(folder), df.schema, 2))
        return s.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(**trigger).start()

    def later():
        time.sleep(3)
        df.where("event_id >= 100").write.mode("append").parquet(str(folder))
        (folder / "final_summary_1.txt").write_text("done")

    t = threading.Thread(target=later)
    t.start()
    live.until_sentinel(spark, str(folder), start, most_seconds=60)
    t.join()
    assert seen["rows"] == sorted(map(tuple, live.running_counts(df).collect()))
    assert sorted(map(tuple, live.running_counts_to_table(spark, str(folder)).collect())) == seen["rows"]
