import math

import pytest

from strandlake.plans import main_run
from strandlake.plans.settings import RunSettings


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for i in range(12):
        cigar = {0: "40M", 1: "5M", 2: "20M5I20M", 3: "10S30M"}[i % 4]
        size = {0: 40, 1: 5, 2: 45, 3: 40}[i % 4]
        rows.append((f"r{i:02d}", "chr1", 100 + i, 1 if i % 2 else -1, 60, cigar, "A" * size, None, None, 0, f"REF{i}"))
    rows.append(("r00", "chr2", 7, 1, 3, "40M", "A" * 40, None, None, 1, "SECOND"))
    alignments = spark.createDataFrame(rows, "read_id string, chrm string, pos long, strand int, mapq int, cigar string, seq string, qual string, tags array<string>, map_num int, ref_seq string")
    mods = spark.createDataFrame([("chr1", p, 1, f"r{i:02d}", "m", math.log(0.95 if i % 3 else 0.02)) for i in range(12) for p in (101, 120)], "chrm string, pos long, strand int, read_id string, mod_base string, score double")
    var = spark.createDataFrame([("chr1", 121, "C", a, f"r{i:02d}", math.log(x)) for i in range(12) for a, x in (("G", 0.9), ("T", 0.05))] + [("chr1", 122, "C", "C" + "A" * 60, "r00", -1.0)], "contig string, pos long, ref_seq string, alt_seq string, read_id string, score double")
    contigs = spark.createDataFrame([("chr1", 1000, 0), ("chr2", 500, 1)], "chrm string, chrm_len long, number long")
    return {"alignments": alignments, "mod_calls": mods, "var_calls": var, "contigs": contigs}


def lines(folder):
    return [x for p in sorted(folder.rglob("part-*.txt")) for x in p.read_text().splitlines()]


def test_all_outputs_of_passing_reads(spark, tables, tmp_path):
    s = RunSettings(outputs=("mappings", "per_read_refs", "mods", "variants"), ref_length_range=(10, None), percent_coverage=80.0, mod_output_formats=("bedmethyl", "wiggle", "modvcf"), heterozygous_factors=(0.9, 0.8))
    counts = main_run.run(s, str(tmp_path / "o"), **tables)
    assert counts == {"rows": 12, "good": 6, "reference too short": 3, "coverage": 3}
    o = tmp_path / "o"
    bad = {r["read_id"]: r["reason"] for r in spark.read.parquet(str(o / "rejected")).collect()}
    assert bad == {f"r{i:02d}": "reference too short" if i % 4 == 1 else "coverage" for i in range(12) if i % 4 in (1, 3)}
    sam = lines(o / "mappings")
    assert sam[0].startswith("@HD") and sorted(x.split("\t")[0] for x in sam[3:]) == sorted([*(f"r{i:02d}" for i in range(12) if i % 2 == 0), "r00"])
    assert sorted(x for x in lines(o / "per_read_refs") if not x.startswith(">")) == sorted(f"REF{i}" for i in range(0, 12, 2))
    per = spark.read.parquet(str(o / "per_read_mods"))
    assert per.count() == 12 and {r["read_id"] for r in per.collect()} == {f"r{i:02d}" for i in range(0, 12, 2)}
    bed = [x.split("\t") for x in lines(o / "mods" / "bedmethyl")]
    assert [(x[1], x[9], x[10]) for x in bed] == [("101", "6", "66.7"), ("120", "6", "66.7")]
    assert lines(o / "mods" / "wiggle")[0].startswith("track") and len(lines(o / "mods" / "modvcf")) == 2
    assert spark.read.parquet(str(o / "per_read_variants")).where("length(alt_seq) > 50").count() == 0
    vcf = lines(o / "variants")
    assert vcf[0] == "##fileformat=VCFv4.2" and vcf[1:3] == ["##contig=<ID=chr1,length=1000>", "##contig=<ID=chr2,length=500>"]
    assert [x.split("\t")[:5] for x in vcf[4:]] == [["chr1", "122", ".", "C", "G,T"]] and vcf[4].split("\t")[9].startswith("1/1:6:")


def test_limits_methods_and_haploid_calls(spark, tables, tmp_path):
    s = RunSettings(outputs=("mods", "variants"), num_reads=4, mod_aggregate_method="expit", haploid=True, edge_buffer=2)
    assert main_run.run(s, str(tmp_path / "o"), **tables) == {"rows": 4, "good": 4}
    # Position 101 is within two bases of the reads' ends, as is 121 of the shortest read's.
    assert {(r["pos"], r["read_id"]) for r in spark.read.parquet(str(tmp_path / "o" / "per_read_mods")).collect()} == {(120, "r00"), (120, "r02"), (120, "r03")}
    record = lines(tmp_path / "o" / "variants")[-1].split("\t")
    assert record[4] == "G,T" and record[9].split(":")[0] == "1"


def test_what_tables_cannot_give_is_refused(tables, tmp_path):
    for outputs, given in ((("basecalls",), tables), (("mods",), {"alignments": tables["alignments"]}), (("variants",), {k: v for k, v in tables.items() if k != "contigs"})):
        with pytest.raises(ValueError):
            main_run.run(RunSettings(outputs=outputs), str(tmp_path / "x"), **given)
    assert not (tmp_path / "x").exists()
