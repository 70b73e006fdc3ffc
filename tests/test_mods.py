import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import mods

INF = float("inf")


def calls(spark, rows):
    return spark.createDataFrame([("chr1", p, s, r, m, float(x)) for p, s, r, m, x in rows], "chrm string, pos long, strand int, read_id long, mod_base string, score double")


def table(df, *value):
    return {(r["pos"], r["strand"], r["mod_base"]): tuple(r[v] for v in value) for r in df.collect()}


LN = math.log


def test_threshold_cases(spark):
    rows = [
        (1, 1, 1, "m", LN(0.9)), (1, 1, 1, "h", LN(0.05)),  # confident m
        (1, 1, 2, "m", LN(0.05)), (1, 1, 2, "h", LN(0.05)),  # confident canonical
        (1, 1, 3, "m", LN(0.5)), (1, 1, 3, "h", LN(0.2)),  # winner not confident
        (2, 1, 1, "m", LN(0.4)), (2, 1, 1, "h", LN(0.4)),  # site without a confident read
        (3, -1, 1, "m", LN(0.8)), (3, -1, 1, "h", LN(0.1)),  # at the threshold: strict
        (3, 1, 1, "m", LN(0.85)),  # a mod missing; other strand of one position
        (4, 1, 1, "m", 0.0), (4, 1, 1, "h", -INF),  # sum exactly one
        (5, 1, 1, "m", 0.0), (5, 1, 1, "h", LN(0.5)),  # sum above one: NaN canonical loses
        (6, 1, 1, "m", LN(0.45)), (6, 1, 1, "h", LN(0.45)), (6, 1, 1, "m", LN(0.95)),  # repeated: the largest counts
    ]
    got = table(mods.binary_threshold(calls(spark, rows), mods=["h", "m"]), "reads", "valid_reads", "n_mod", "prop")
    assert got[1, 1, "m"] == (3, 2, 1, 0.5) and got[1, 1, "h"] == (3, 2, 0, 0.0)
    assert got[2, 1, "m"] == (1, 0, 0, 0.0)
    assert got[3, -1, "m"][1] == int(math.exp(LN(0.8)) > 0.8) and got[3, 1, "m"] == (1, 1, 1, 1.0)
    assert got[4, 1, "m"] == (1, 1, 1, 1.0) and got[5, 1, "m"] == (1, 1, 1, 1.0) and got[6, 1, "m"] == (1, 1, 1, 1.0)


def test_ties_take_the_first_mod_and_canonical_needs_more(spark):
    tie = LN(0.4)
    got = {r["read_id"]: r["winner"] for r in mods.winners(mods.read_level(calls(spark, [(1, 1, 1, "m", tie), (1, 1, 1, "h", tie), (1, 1, 2, "m", LN(0.5))]), ["h", "m"]), ["h", "m"]).collect()}
    assert got == {1: "h", 2: "m"}


def loop_em(p, iterations=15, tol=0.001, least=0.001):
    n, k = p.shape
    mix = np.array([sum(np.argmax(r) == j for r in p) / n for j in range(k)])
    mix = np.clip(mix, least, 1)
    mix /= mix.sum()
    for _ in range(iterations):
        new = np.mean([r * mix / (r * mix).sum() for r in p], axis=0)
        new = np.clip(new, least, 1)
        new /= new.sum()
        done = np.abs(new - mix).max() < tol
        mix = new
        if done:
            break
    return [0.0 if x <= least * 1.000001 else 1.0 if x >= 1 - 1.000001 * (k - 1) * least else x for x in mix]


def test_em_matches_a_loop(spark):
    r = np.random.default_rng(0)
    rows, want = [], {}
    for site in range(6):
        p = r.dirichlet([1, 1, 1] if site % 2 else [5, 0.2, 0.2], 25)
        p = np.round(p * 4096) / 4096
        p[:, 0] = 1 - p[:, 1:].sum(1)
        for i, x in enumerate(p):
            rows += [(site, 1, i, "h", LN(max(x[1], 1e-9))), (site, 1, i, "m", LN(max(x[2], 1e-9)))]
        want[site] = loop_em(p)
    rows.append((0, 1, 99, "m", LN(0.3)))  # lacks a mod
    out = mods.em(calls(spark, rows), mods=["h", "m"]).collect()
    assert {r["dropped_reads"] for r in out if r["pos"] == 0} == {1}
    for row in out:
        assert abs(row["prop"] - want[row["pos"]][1 if row["mod_base"] == "h" else 2]) < 2e-3
    assert mods.em(calls(spark, [(1, 1, 1, "m", -1.0)]), mods=["h", "m"]).count() == 0


def test_em_takes_scores_as_they_are_at_any_depth(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for site in range(4):
        p = r.dirichlet([1, 0.3, 0.1] if site % 2 else [0.1, 0.1, 3], 40)
        scores = np.log(np.maximum(p[:, 1:], 1e-12))
        for i, (h, m) in enumerate(scores.tolist()):
            rows += [(site, 1, i, "h", h), (site, 1, i, "m", m)]
        q = np.exp(scores)
        want[site] = loop_em(np.concatenate([np.maximum(1 - q.sum(1, keepdims=True), 0), q], 1))
    rows.append((0, 1, 99, "m", LN(0.3)))  # lacks a mod
    rows += [(1, 1, i, "m", -1.0) for i in range(100, 105)]
    for deep in (10_000, 42, 1):
        out = mods.em(calls(spark, rows), mods=["h", "m"], deep=deep).collect()
        assert len(out) == 8
        assert {r["pos"]: (r["reads"], r["dropped_reads"]) for r in out} == {0: (41, 1), 1: (45, 5), 2: (40, 0), 3: (40, 0)}
        for row in out:
            assert abs(row["prop"] - want[row["pos"]][1 if row["mod_base"] == "h" else 2]) < 1e-6


def test_position_codes_round_trip(spark):
    contigs = spark.createDataFrame([("chr10", 50), ("chr2", 30), ("chrX", 9)], "chrm string, chrm_len long")
    off = mods.contig_offsets(contigs)
    assert [(r["chrm"], r["offset"]) for r in off.orderBy("offset").collect()] == [("chr2", 0), ("chr10", 60), ("chrX", 160)]
    rows = spark.createDataFrame([("chr2", 0, 1), ("chr2", 29, -1), ("chr10", 0, 1), ("chrX", 8, -1)], "chrm string, pos long, strand int")
    coded = mods.encode_positions(rows, off)
    back = mods.decode_positions(coded.select("pos_id"), off).select("chrm", "pos", "strand")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="beyond contig"):
        mods.encode_positions(spark.createDataFrame([("chrX", 9, 1)], "chrm string, pos long, strand int"), off).collect()


def test_per_site_percentiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=31).tolist()
    df = spark.createDataFrame([(v, p) for p in (0.0, 0.13, 0.5, 0.99, 1.0)], "v array<double>, p double")
    for row in df.select("p", mods.array_percentile(F.col("v"), F.col("p")).alias("q")).collect():
        assert math.isclose(row["q"], np.percentile(v, 100 * row["p"]))


def test_sites_without_strand_stand_for_both(spark):
    c = calls(spark, [(1, 1, 1, "m", -1), (1, -1, 1, "m", -1), (2, 1, 1, "m", -1), (2, -1, 1, "m", -1)])
    s = spark.createDataFrame([("chr1", 1, None), ("chr1", 2, -1)], "chrm string, pos long, strand int")
    assert sorted((r["pos"], r["strand"]) for r in mods.at_sites(c, s).collect()) == [(1, -1), (1, 1), (2, -1)]


def test_edge_buffer_is_strict_for_mods_only(spark):
    c = spark.createDataFrame([(1, p) for p in (10, 15, 16, 25, 30)], "read_id long, pos long")
    r = spark.createDataFrame([(1, 10, 30)], "read_id long, r_st long, r_en long")
    keep = lambda b, v: sorted(x["pos"] for x in mods.edge_buffer(c, r, b, v).collect())
    assert keep(0, False) == [15, 16, 25] and keep(0, True) == [10, 15, 16, 25, 30] and keep(5, False) == [16] and keep(5, True) == [15, 16, 25]


def test_methods_and_read_filter(spark):
    c = calls(spark, [(1, 1, i, m, LN(0.9 if m == "m" else 0.05)) for i in range(4) for m in "hm"])
    some = spark.createDataFrame([(0,), (1,), (77,)], "read_id long")
    for method in mods.METHODS:
        rows = mods.aggregate(c, method, reads=some, mods=["h", "m"]).collect()
        assert {r["reads"] for r in rows} == {2}
    assert mods.binary_threshold(c.limit(0), mods=["h", "m"]).count() == 0


@pytest.mark.parametrize("fraction", [None, 0.3])
def test_global_threshold_goes_over_the_scores_once(spark, fraction):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = np.random.default_rng(5)
    # Repeated scores, both zeros, none, and NaN, which counts as high where the fraction is estimated.
    scores = [*np.round(rng.normal(0, 3, 400), 1).tolist(), *rng.normal(-2, 1, 200).tolist(), 0.0, -0.0, None, float("nan"), float("nan")]
    rows = [(m, x) for m in "hm" for x in scores]
    llrs = spark.createDataFrame(rows, "mod_base string, llr double").mapInArrow(count, "mod_base string, llr double")
    got = mods.global_threshold(llrs, "m", fraction=fraction).collect()
    x = np.array([s for s in scores if s is not None and s == s])
    cut = min(abs(np.quantile(x, 0.08)), abs(np.quantile(x, 0.92)))
    low, high = (x <= -cut).sum(), (x >= cut).sum() + 2
    f = fraction or low / (low + high)
    assert len(got) == 1 and got[0]["mod_base"] == "m" and got[0]["frac_mod"] == pytest.approx(f, abs=1e-12) and got[0]["threshold"] == pytest.approx(np.quantile(x, f), abs=1e-12)
    assert seen.value == len(rows)
