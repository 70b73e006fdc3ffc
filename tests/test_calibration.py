import math
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from strandlake.operators import calibrate
from strandlake.plans import commands

SCHEMA = "mod_base string, is_mod boolean, llr double"


def loop_density(xs, grid, bw=0.8):
    """Unimodal density of scores moved to cells of a hundredth of the bandwidth."""
    y = [sum(math.exp(-(((g - round(x / (bw / 100)) * bw / 100) / bw) ** 2) / 2) for x in xs if abs(g - round(x / (bw / 100)) * bw / 100) <= 8 * bw) / (bw * math.sqrt(2 * math.pi)) / len(xs) for g in grid]
    top = y.index(max(y))
    before = [(max(y[: i + 1]) + min(y[i:top])) / 2 for i in range(top)]
    after = [(min(y[top : i + 1]) + max(y[i:])) / 2 for i in range(top, len(y))]
    return before + after, top


def loop_table(c, m, middle):
    p = [b / (a + b) if a + b > 0 else None for a, b in zip(c, m, strict=True)]
    middle = min(range(len(p)), key=lambda i: abs(p[i] - 0.5)) if middle is None else middle

    def flat(part, how):
        return None if None in part else how(part)

    q = [flat(p[i:middle], max) if i < middle else flat(p[middle : i + 1], min) for i in range(len(p))]
    return [None if x is None else math.inf if x <= 0 else -math.inf if x >= 1 else math.log((1 - x) / x) for x in q]


def loop_fit(canonical, modified, most, points, mirrored=False, eps=1e-6, least=5e-8):
    half = round(points / 2)

    def pair(grid):
        c = loop_density(canonical, grid)
        return c, ((c[0][::-1], len(grid) - 1 - c[1]) if mirrored else loop_density(modified, grid))

    grid = np.linspace(-most, most, points).tolist()
    (c, ct), (m, mt) = pair(grid)
    t = loop_table(c, m, half)
    moves = [i for i in range(points - 1) if t[i] is not None and t[i + 1] is not None and t[i] != t[i + 1] and t[i + 1] - t[i] > eps]
    low = max(i for y, top in ((c, ct), (m, mt)) for i in [0, *(i for i in range(top) if y[i] < least)])
    high = min(i for y, top in ((c, ct), (m, mt)) for i in [points - 1, *(i - 1 for i in range(top, points) if y[i] < least)])
    low, high = max(round(grid[moves[0]]) - 1, round(grid[low])), min(round(grid[moves[-1]]) + 1, round(grid[high]))
    (c, _), (m, _) = pair(np.linspace(low, high, points).tolist())
    return low, high, loop_table(c, m, half if mirrored else None)


def test_fit_in_two_passes_against_loops(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(3, 2, 300).tolist(), (r.normal(-4, 1.5, 200)).tolist() + r.normal(5, 1, 20).tolist()
    rows = [("m", False, x) for x in a] + [("m", True, x) for x in b] + [("m", False, None), ("m", True, float("nan"))]
    got = calibrate.fit(spark.createDataFrame(rows, SCHEMA), max_llr=30.0, points=61).first()
    low, high, table = loop_fit(a, b, 30.0, 61)
    assert (got["lo"], got["hi"]) == (low, high) and np.allclose(got["table"], table, atol=1e-7) and (np.diff(got["table"]) >= 0).all()
    mirror = calibrate.fit(spark.createDataFrame(rows, SCHEMA), max_llr=30.0, points=61, mirrored=True).first()
    low, high, table = loop_fit(a, None, 30.0, 61, True)
    assert (mirror["lo"], mirror["hi"]) == (low, high) and np.allclose(mirror["table"], table, atol=1e-7)


def test_classes_apart_are_an_error(spark):
    rows = [("m", False, 25.0 + i / 10) for i in range(30)] + [("m", True, -25.0 - i / 10) for i in range(30)]
    with pytest.raises(PySparkException, match="do not overlap"):
        calibrate.fit(spark.createDataFrame(rows, SCHEMA), max_llr=30.0, points=61).collect()


VARIANTS = "is_ref_correct string, llr double, ref_seq string, alt_seq string"


def test_variant_statistics_by_rule(spark):
    rows = [("True", float(i % 40), "ACGT"[i % 4], "ACGT"[(i + 1 + i % 3) % 4]) for i in range(500)] + [("True", 1.0, "AC", "A"), ("True", 2.0, "A", "AC"), ("True", 3.0, "ACC", "A"), ("True", 3.0, "A", "AGG")]
    rows += [("False", 9.0, "A", "C"), ("True", None, "A", "C"), ("True", float("nan"), "A", "C"), ("True", 5.0, "A" * 60, "A")]
    out = calibrate.variant_stats(spark.createDataFrame(rows, VARIANTS).repartition(3), 50)
    counts = Counter()
    for r in out.collect():
        assert r["is_mod"] is False
        counts[r["key"]] += r["n"]
    singles = Counter(f"{a}>{b}" for ok, x, a, b in rows if ok == "True" and x is not None and x == x and len(a) == len(b) == 1)
    assert counts == singles | Counter({"del1": 1, "ins1": 1, "del2": 1, "ins2": 1, "N>N": sum(singles.values()) // 12})
    again = calibrate.variant_stats(spark.createDataFrame(rows[::-1], VARIANTS), 50)
    assert sorted(out.collect()) == sorted(again.collect())


@pytest.mark.parametrize("keys", [["del1", "ins1"], ["A>C", "del1"], ["A>C", "ins1", "del2"], ["A>C", "ins2", "del2"], ["A>C", "ins0", "ins1", "del1"], ["N>N", "ins1", "del1"]])
def test_variant_kinds_that_are_missing_are_an_error(keys):
    with pytest.raises(ValueError):
        calibrate.check_variant_keys(keys)


def test_variant_tables_are_fitted_stored_and_applied(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [("True", float(x), *v) for v in (("A", "C"), ("G", "T"), ("A", "AT"), ("AT", "A")) for x in r.normal(3, 3, 200)]
    tables = commands.COMMANDS["calibrate variants"](spark.createDataFrame(rows, VARIANTS), max_llr=30.0, points=61)
    calibrate.store(tables, str(tmp_path / "t"), "key")
    loaded = calibrate.load(spark, str(tmp_path / "t"), "key")
    kept = {x["key"]: x for x in loaded.collect()}
    assert set(kept) == {"A>C", "G>T", "N>N", "ins1", "del1"}
    asked = [("A", "C", 1.3), ("CAT", "CCT", 1.3), ("A", "G", 1.3), ("AC", "GT", 1.3), ("AT", "ATT", -2.0), ("A", "ACCCC", -2.0), ("ACC", "A", 99.0)]
    used = ["A>C", "A>C", "N>N", "N>N", "ins1", "ins1", "del1"]
    df = spark.createDataFrame(asked, "ref_seq string, alt_seq string, llr double")
    got = {(x["ref_seq"], x["alt_seq"]): x["calibrated"] for x in calibrate.calibrate_variants(df, loaded).collect()}
    for (ref, alt, x), key in zip(asked, used, strict=True):
        t = kept[key]
        grid = np.linspace(t["lo"], t["hi"], 61)
        assert got[ref, alt] == t["table"][min(np.searchsorted(grid, x), 60)]


def test_stored_tables_are_checked(spark, tmp_path):
    tables = spark.createDataFrame([("m", -1.0, 1.0, [0.0, 1.0])], "mod_base string, lo double, hi double, table array<double>")
    calibrate.store(tables, str(tmp_path / "a"), "mod_base")
    assert calibrate.load(spark, str(tmp_path / "a"), "mod_base").count() == 1
    tables.write.parquet(str(tmp_path / "half" / "tables"))
    other = tmp_path / "other"
    calibrate.store(tables, str(other), "mod_base")
    tables.union(tables).write.mode("overwrite").parquet(str(other / "tables"))
    for path, key in (("a", "key"), ("half", "mod_base"), ("none", "mod_base"), ("other", "mod_base")):
        with pytest.raises(ValueError):
            calibrate.load(spark, str(tmp_path / path), key)
