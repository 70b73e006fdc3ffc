import random
import re

import pyarrow as pa
import pytest

from strandlake.operators import intervals, sites, tiles, variants


@pytest.fixture(scope="module")
def genome():
    r = random.Random(4)
    out = {f"c{i}": "".join(r.choice("ACGT") for _ in range(n)) for i, n in enumerate([1, 57, 100, 333])}
    return out | {"rep": "G" + "AT" * 120 + "C" + "A" * 95 + "T", "all": "A" * 90}


@pytest.fixture(scope="module")
def contigs(spark, genome):
    return spark.createDataFrame(list(genome.items()), "contig string, seq string")


def loop_hits(seq, motif):
    body = "".join({"W": "[AT]", "N": "[ACGT]", "H": "[ACT]", "D": "[AGT]"}.get(x, x) for x in motif)
    return [m.start() for m in re.finditer(f"(?={body})", seq)]


@pytest.mark.parametrize("width", [3, 10, 57, 1000])
def test_motifs_across_cuts(spark, genome, contigs, width):
    chroms = contigs.withColumnRenamed("contig", "chrom")
    for motif, at, back in (("CG", 0, "CG"), ("AWA", 1, "TWT"), ("A", 0, "T"), ("CHG", 2, "CDG")):
        got = sorted(map(tuple, sites.motif_sites(chroms, motif, at, width).collect()))
        want = [(c, p + at, 1) for c, s in genome.items() for p in loop_hits(s, motif)] + [(c, p + len(motif) - 1 - at, -1) for c, s in genome.items() for p in loop_hits(s, back)]
        assert got == sorted(want)
    with pytest.raises(ValueError):
        sites.motif_sites(chroms, "A" * (width + 2), 0, width)


def test_sites_by_motif_on_tiles(spark, genome, contigs):
    rows = [(c, p, s, p % 3) for c, x in genome.items() for p in range(len(x)) for s in (1, -1)] + [("unknown", 3, 1, 0), ("c1", 5, 1, 9)]
    df = spark.createDataFrame(rows, "chrom string, pos long, strand int, extra long")
    motifs = [("CG", 0), ("CHG", 0), ("CHH", 0)]
    cut = tiles.from_contigs(contigs, width=10)
    assert cut.selectExpr("max(length(letters))").first()[0] == 10
    complement = str.maketrans("ACGT", "TGCA")

    def first(c, p, s):
        x = genome[c] if s == 1 else genome[c][::-1].translate(complement)
        p = p if s == 1 else len(x) - 1 - p
        return next((m for m, _ in motifs if re.match(m.replace("H", "[ACT]"), x[p:])), None)

    want = sorted((c, p, s, e, first(c, p, s) or "") for c, p, s, e in rows if c != "unknown")
    for letters in (contigs.withColumnRenamed("contig", "chrom"), cut):
        got = sites.split_by_motif(df, letters, motifs, 10 if "tile" in letters.columns else 100)
        assert sorted((*r[:4], r[4] or "") for r in got.collect()) == want


@pytest.mark.parametrize("width", [7, 1000])
def test_indels_are_carried_over_tiles(spark, genome, contigs, width):
    rows = [("rep", p, ref, alt) for p in (1, 30, 100, 231, 242, 300) for ref, alt in (("", "AT"), ("", "A"), (genome["rep"][p : p + 2], ""), (genome["rep"][p], ""), ("A", "C"))]
    rows += [("all", 40, "A", ""), ("all", 0, "A", ""), ("c0", 0, "", "G"), ("c3", 333, "", "T"), ("nowhere", 1, "", "A"), ("rep", 30, "", "AT")]
    df = spark.createDataFrame(rows, "contig string, pos long, ref string, alt string")
    want = [(c, *x) for c, p, r, a in rows if c in genome and (x := variants.expand_indel(genome[c], p, r, a))]
    cut = tiles.from_contigs(contigs, width=width)
    assert sorted(map(tuple, variants.expand_indels(df, cut, width).collect())) == sorted(want)
    assert any(len(r) > 200 for _, _, r, _ in want)


@pytest.mark.parametrize("width", [4, 1000])
def test_context_bases_and_reference_alleles(spark, genome, contigs, width):
    s = genome["c3"]
    cut = tiles.from_contigs(contigs, width=width)
    rows = [("c3", p, s[p : p + n], [s[p : p + n][:k], "ACGT"]) for p in (1, 4, 7, 8, 100, 331) for n in (0, 1, 9) for k in (0, 1)] + [("c3", 0, "", ["A"]), ("none", 4, "A", ["C"])]
    df = spark.createDataFrame(rows, "contig string, pos long, ref string, alts array<string>")
    want = []
    for c, p, r, a in rows:
        if c == "c3" and (r and all(a)):
            want.append((c, p, r, a))
        elif c == "c3" and p:
            want.append((c, p - 1, s[p - 1] + r, [s[p - 1] + x for x in a]))
    got = [tuple(r) for r in variants.add_context_base(df, cut, width).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    wrong = [("c3", 5, "N" + s[6:9]), ("c3", 5, s[5:13] + "N"), ("c3", 330, s[330:] + "A"), ("none", 4, "A"), ("c3", 400, "A"), (None, 1, "A")]
    right = [("c3", 5, s[5:30]), ("c3", 0, s[0]), ("c3", 332, s[332]), ("c3", 9, "")]
    df = spark.createDataFrame([*wrong, *wrong[:1], *right], "contig string, pos long, ref string")
    assert sorted(map(str, map(tuple, variants.check_reference(df, cut, width).collect()))) == sorted(map(str, [*wrong, *wrong[:1]]))


def test_fasta_to_tiles(spark, genome, tmp_path):
    lines = []
    for c, s in genome.items():
        lines += [f">{c} some words", *[s[i : i + 13] for i in range(0, len(s), 13)], ""]
    (tmp_path / "a.fa").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = tiles.from_fasta(spark, str(tmp_path), 20).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["contig"], r["tile"]): r["letters"] for r in got} == {(c, i // 20): s[i : i + 20] for c, s in genome.items() for i in range(0, len(s), 20)}


def spans(n, seed, most):
    r = random.Random(seed)
    out = []
    for i in range(n):
        start, size = r.randrange(most), int(10 ** r.uniform(0, 8)) if i % 3 else r.randrange(1, 50)
        out.append((f"k{i % 2}", start, start + size, i))
    return out


def test_interval_joins_over_lengths_from_one_to_1e8(spark):
    a, b = spans(150, 1, 10**8), spans(150, 2, 10**8)
    rng = random.Random(3)
    points = [(f"k{i % 2}", rng.randrange(2 * 10**8)) for i in range(300)] + [("k0", a[0][1]), ("k0", a[0][2]), ("k0", a[0][2] - 1)]
    schema = "key string, start long, end long, id long"
    da, db, dp = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), spark.createDataFrame(points, "key string, pos long")
    got = sorted((r["id"], r["pos"]) for r in intervals.points_in_intervals(da, dp, ["key"], "start", "end", "pos").collect())
    assert got == sorted((i, p) for k, s, e, i in a for q, p in points if k == q and s <= p < e)
    pairs = sorted((r["id"], r["b_id"]) for r in intervals.overlaps(da, db, ["key"]).collect())
    assert pairs == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    odd = spark.createDataFrame([*a, ("k0", a[0][1], a[0][2], None), (None, 1, 5, 7), ("k1", 5, 5, 8)], schema)
    hit = {(k, s, e) for k, s, e, _ in [*a, ("k0", a[0][1], a[0][2], None)] if any(k == q and s <= p < e for q, p in points)}
    for how in ("left_semi", "left_anti"):
        rows = {tuple(r) for r in intervals.points_in_intervals(odd, dp, ["key"], "start", "end", "pos", how=how).collect()}
        assert rows == {tuple(r) for r in odd.collect() if (tuple(r[:3]) in hit) == (how == "left_semi")}


def test_a_whole_contig_costs_few_rows(spark):
    df = spark.createDataFrame([("c", 12_345, 248_000_000, 1)], "key string, start long, end long, id long")
    assert intervals._own_bins(df, "start", "end", 128).count() <= 3


def loop_pass(rows):
    out = []
    for r in sorted(rows, key=lambda r: r[:3]):
        if not out or r[0] >= out[-1][1]:
            out.append(r)
        elif r[3] is not None and out[-1][3] is not None and r[3] > out[-1][3]:
            out[-1] = r
    return out


@pytest.mark.parametrize("stretch", [1, 7, 60, 10_000])
def test_overlaps_resolve_in_stretches(spark, stretch):
    rows = []
    for c in range(6):
        r = random.Random(c)
        for i in range(80):
            s = r.randrange(0, 250)
            size = (r.randrange(0, 4), r.randrange(1, 40), r.choice([1, 400]), 3, r.randrange(1, 12), 30)[c]
            q = (float(r.randrange(4)), float(i), -float(s), r.random(), None if i % 5 == 0 else float(r.randrange(3)), 1.0)[c]
            rows.append((f"c{c}", s, s + size, i, q))
    df = spark.createDataFrame(rows, "contig string, start long, end long, id long, qual double").repartition(5)
    got = sorted((tuple(r) for r in intervals.resolve_overlaps(df, ["contig"], "qual", "id", stretch=stretch).collect()), key=str)
    assert got == sorted(((c, *x) for c in {r[0] for r in rows} for x in loop_pass([r[1:] for r in rows if r[0] == c])), key=str)


def test_a_chain_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'c' as contig", "id * 3 as start", "id * 3 + 10 as end", "id", "cast(hash(id) % 1000 as double) as qual")
    got = [r["id"] for r in intervals.resolve_overlaps(df, ["contig"], "qual", "id", stretch=100_000).orderBy("start").collect()]
    want = loop_pass([(r["start"], r["end"], r["id"], r["qual"]) for r in df.toLocalIterator()])
    assert got == [r[2] for r in want]


def test_runs_are_few_where_survivors_meet():
    r = random.Random(5)
    rows = sorted((s := r.randrange(10_000), s + r.randrange(1, 30), i, r.random()) for i in range(5000))
    table = pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=["s", "e", "i", "q"])
    assert len(intervals.Pass(table).runs()) < 30
