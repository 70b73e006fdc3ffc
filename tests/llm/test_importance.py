import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from strandlake.llm import importance
from strandlake.llm.importance import BUCKETS, bucket_counts, resample
from tests_llm_prose import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def counts_of(text, buckets=BUCKETS):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(rows, target):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    mine, s, t = [counts_of(x) for _, x in rows], Counter(), Counter()
    for c in mine:
        s.update(c)
    for x in target:
        t.update(counts_of(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for (d, x), c in zip(rows, mine, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * n for b, n in c.items())
        out.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)), None])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[5] = k
    return sorted((tuple(r[:4] + r[5:]) for r in out), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_odd_rows_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(200 + i, prose(i % 37, 15 + i % 9)) for i in range(150)]
    rows += [(500, "Été ÉTÉ naïve-Œuvre \0 x\0y 日本語 ok"), (501, "one"), (502, "one TWO"), (503, "[a]^_`{b}@C 12"), (504, prose(1, 30)), (504, prose(2, 30))]
    target = [prose(2, 60), prose(9, 80), None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as buckets", "2 as rank").repartition(5)
    out = resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert [t for _, t in out.dtypes] == ["bigint"] * 5
    want = brute(rows, target)
    assert got(out) == want and sum(r[4] is not None for r in want) >= 5


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE_CHARS", 40)
    texts = [prose(3, 500), "x" * 300, "a b c d e " * 60, "日本" * 100, "", "tail words at the end of a text, longer than one piece of it"]
    words, ends, buckets, counts = importance.FeatureCounter(BUCKETS).count(texts)
    for i, t in enumerate(texts):
        own = slice(ends[i], ends[i + 1])
        assert words[i] == len(words_of(t)) and dict(zip(buckets[own].tolist(), counts[own].tolist(), strict=True)) == dict(counts_of(t))


def test_crc_of_appended_bytes_is_that_of_zlib():
    import numpy as np

    r = np.random.default_rng(1)
    parts = [(r.bytes(int(a)), r.bytes(int(b))) for a, b in zip(r.integers(0, 40, 300), [*r.integers(0, 80, 298), 5000, 70_001], strict=True)]
    got = importance.append(*(np.array(x) for x in zip(*[(zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in parts], strict=True)))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]
    assert importance.append(*(np.zeros(0, np.int64),) * 3).tolist() == []


def test_ties_go_to_the_smaller_identifier(spark):
    rows = [(d, prose(5, 40)) for d in (7, 7, None, None)] + [(i, prose(i, 25)) for i in range(20, 60)]
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(prose(5, 40),)], "text string")
    assert got(resample(df, target)) == brute(rows, [prose(5, 40)])


def test_empty_tables(spark, empty):
    target = spark.createDataFrame([("a target text",)], "text string")
    assert resample(empty, target).count() == 0
    rows = [(i, prose(i, 30)) for i in range(40)]
    assert got(resample(spark.createDataFrame(rows, "doc_id long, text string"), target.limit(0))) == brute(rows, [])
    assert bucket_counts(empty, keep=("doc_id",)).columns == ["c0", "n_words", "buckets", "counts"]


def test_query_on_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    pytest.importorskip("duckdb")
    from strandlake.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    assert got(QUERIES["op13_importance_resampling"](spark, d)) == brute(rows, target)
