from strandlake.sources import text


def lines_of(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_wiggle_files_are_what_readers_expect(spark, tmp_path):
    rows = [("m", 1, c, p, p / 100) for c in ("chr10", "chr2") for p in range(0, 30, 3)] + [("m", -1, "chr2", 4, 0.5), ("h", 1, "chr2", 4, 0.25)]
    calls = spark.createDataFrame(rows, "mod_base string, strand int, chrm string, pos long, prop double").repartition(5)
    text.write_ordered(text.wiggle_files(calls), text.in_file_order(), str(tmp_path / "w"), "file")
    assert sorted(p.name for p in (tmp_path / "w").glob("file=*")) == ["file=h.fwd_strand", "file=m.fwd_strand", "file=m.rev_strand"]
    got = lines_of(tmp_path / "w" / "file=m.fwd_strand")
    want = ['track type=wiggle_0 name="m.fwd_strand" description="m.fwd_strand"']
    for c in ("chr2", "chr10"):
        want += [f"variableStep chrom={c} span=1", *(f"{p + 1} {p / 100:.6f}" for p in range(0, 30, 3))]
    assert got == want


def test_sam_file_has_its_header_first_and_marks_later_mappings(spark, tmp_path):
    rows = [(f"r{i}", c, 50 - i, 1 - 2 * (i % 2), 60, "4M", "ACGU", None, None, i % 3) for i in range(6) for c in ("b", "a")]
    a = spark.createDataFrame(rows, "read_id string, chrm string, pos long, strand int, mapq int, cigar string, seq string, qual string, tags array<string>, map_num int")
    contigs = spark.createDataFrame([("b", 99, 0), ("a", 77, 1)], "chrm string, chrm_len long, number long")
    text.write_ordered(text.sam_file(a, contigs), ["part", "number", "pos", "value"], str(tmp_path / "s"))
    got = [x.split("\t") for x in lines_of(tmp_path / "s")]
    assert got[:3] == [["@HD", "VN:1.6", "SO:coordinate"], ["@SQ", "SN:b", "LN:99"], ["@SQ", "SN:a", "LN:77"]]
    body = got[3:]
    assert [(x[2], int(x[3])) for x in body] == [(c, p + 1) for c in "ba" for p in range(45, 51)]
    assert {x[0]: int(x[1]) for x in body} == {f"r{i}": 16 * (i % 2) + 2048 * (i % 3 > 0) for i in range(6)} and body[0][9] == "ACGT"


def test_vcf_file_and_read_references(spark):
    lines = spark.createDataFrame([("c", 5, "c\t6\t.\tA\tG"), ("c", 1, "c\t2\t.\tA\tG")], "contig string, pos long, value string")
    got = [r["value"] for r in text.vcf_file(lines, [("c", 9)]).orderBy("part", "number", "contig", "pos").collect()]
    assert got[0] == "##fileformat=VCFv4.2" and got[1] == "##contig=<ID=c,length=9>" and got[2].startswith("#CHROM\tPOS") and [x.split("\t")[1] for x in got[3:]] == ["2", "6"]
    reads = spark.createDataFrame([("r1", 0, "ACGT"), ("r1", 1, "TTTT")], "read_id string, map_num int, ref_seq string")
    assert [r["value"] for r in text.read_references(reads).collect()] == [">r1\nACGT"]
