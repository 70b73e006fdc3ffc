import random

import numpy as np
import pytest

from strandlake.operators import intervals
from strandlake.operators.prefix import exact_quantiles, with_previous


@pytest.mark.parametrize("fraction", [0.0, 0.08, 0.3, 0.5, 1.0])
def test_exact_quantiles_by_key(spark, fraction):
    r = random.Random(1)
    rows = [(k, r.choice([0.5, r.gauss(0, 3), float(r.randrange(4))])) for k in "abc" for _ in range({"a": 1, "b": 200, "c": 333}[k])] + [("a", None), ("b", float("nan")), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: (x["n"], x["value"]) for x in exact_quantiles(df.where("k is not null"), ["k"], "v", fraction).collect()}
    held = {k: [v for q, v in rows if q == k and v is not None and v == v] for k in "abc"}
    assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in held.items()}
    assert all(got[k][1] == pytest.approx(np.quantile(v, fraction), abs=1e-12) for k, v in held.items())
    everyone = exact_quantiles(df, [], "v", fraction).first()
    every = [v for _, v in rows if v is not None and v == v]
    assert everyone["n"] == len(every) and everyone["value"] == pytest.approx(np.quantile(every, fraction), abs=1e-12)
    assert exact_quantiles(df.limit(0), ["k"], "v", fraction).count() == 0


def test_previous_values_across_buckets(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randrange(10)])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(7)
    got = {x["i"]: x["before"] for x in with_previous(df, ["k"], "i", "v", "before").collect()}
    last, want = {}, {}
    for k, i, v in rows:
        want[i] = last.get(k)
        last[k] = v
    assert got == want
    bad = {(x["k"], x["i"]) for x in intervals.is_sorted(df, ["k"], "v", "i").collect()}
    assert bad == {(k, i) for k, i, v in rows if v is not None and want[i] is not None and v < want[i]}
