import math
import random

import pytest

from strandlake.operators import variants
from strandlake.plans import commands

CALLS = "locus long, read_id long, alt_seq string, score double, ref_seq string"


def made_up(n, seed):
    r = random.Random(seed)
    rows, truth = [], []
    for locus in range(n):
        p = r.choice([0.1, 0.5, 0.9])
        for read in range(r.randrange(1, 9)):
            x = min(max(r.gauss(0.85 if r.random() < p else 0.15, 0.1), 0.01), 0.99)
            rows.append((locus, read, "A", math.log(x), "C"))
        truth.append((locus, ["SNP", "DEL"][locus % 2], {0.1: "hom_ref", 0.5: "het", 0.9: "hom_alt"}[p] if r.random() < 0.9 else "het"))
    return rows, truth


def f1s(pairs):
    out = {}
    for c in variants.CLASSES:
        hit, called, true = sum(t == h == c for t, h in pairs), sum(h == c for _, h in pairs), sum(t == c for t, _ in pairs)
        out[c] = 2 * hit / (called + true) if hit else None
    some = [v for v in out.values() if v is not None]
    return out | {"mean": sum(some) / len(some) if some else None}


def test_sweep_equals_calling_again_at_each_factor(spark):
    rows, truth = made_up(60, 1)
    calls, known = spark.createDataFrame(rows, CALLS), spark.createDataFrame(truth, "locus long, kind string, truth string")
    sweep = variants.factor_sweep(variants.factor_breaks(variants.diploid(calls), known))
    got = {}
    for r in sweep.collect():
        got.setdefault(r["kind"], []).append(r)
    asked = 0
    for kind, points in got.items():
        points.sort(key=lambda r: r["factor"])
        assert points[0]["factor"] == 0
        edges = [p["factor"] for p in points]
        for i in sorted(random.Random(2).sample(range(1, len(points) - 1), 4)):
            factor = (edges[i] + edges[i + 1]) / 2
            names = {r["locus"]: variants.CLASSES[r["gt"]] for r in variants.diploid(calls, factor).collect()}
            want = f1s([(t, names[locus]) for locus, k, t in truth if k == kind])
            assert all((points[i][f"f1_{c}"] or 0) == pytest.approx(want[c] or 0) for c in variants.CLASSES) and points[i]["mean_f1"] == pytest.approx(want["mean"])
            asked += 1
        best = [r for r in variants.best_factors(sweep).collect() if r["kind"] == kind][0]
        assert best["mean_f1"] == max(p["mean_f1"] for p in points if p["mean_f1"] is not None)
    assert asked == 8


def test_two_factors_by_kind_of_change(spark):
    rows, _ = made_up(12, 3)
    mixed = [(locus, read, "AT" if locus % 3 == 1 else a, s, "CG" if locus % 3 == 2 else ref) for locus, read, a, s, ref in rows]
    df = spark.createDataFrame(mixed, CALLS)
    both = {r["locus"]: r["log_probs"] for r in variants.diploid(df, (0.9, 0.5)).collect()}
    for factor, kind in ((0.9, {0}), (0.5, {1, 2})):
        one = {r["locus"]: r["log_probs"] for r in variants.diploid(df, factor).collect()}
        assert all(both[k] == pytest.approx(one[k]) for k in both if k % 3 in kind)


def test_command_gives_scores_sweep_and_best(spark):
    rows, truth = made_up(20, 5)
    calls, known = spark.createDataFrame(rows, CALLS), spark.createDataFrame(truth, "locus long, kind string, truth string")
    t = spark.createDataFrame([("c", i, "A", "G", "0/1") for i in range(3)], "contig string, pos long, ref string, alt string, gt string")
    out = commands.COMMANDS["variants heterozygous_factor"](t, t, variants.diploid(calls), known)
    assert set(out) == {"scores", "sweep", "best"} and out["best"].count() == 2


def test_breaks_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    breaks = spark.range(30).selectExpr("'SNP' as kind", "element_at(array('hom_ref', 'het', 'hom_alt'), cast(id % 3 as int) + 1) as truth", "'hom_ref' as hom", "id / 10 as at").mapInArrow(count, "kind string, truth string, hom string, at double")
    assert variants.factor_sweep(breaks).count() == 31
    assert seen.value == 30
