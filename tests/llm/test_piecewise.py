import hashlib
import random

import numpy as np

from strandlake.llm import piecewise as pw
from tests_llm_prose import prose


def naive_fingerprint(data):
    """The same fingerprint byte by byte."""
    step, mod = pw._STEP, 1 << 64
    if not data:
        return "3::"
    n = len(data)

    def value(a, b):  # hash of bytes (a, b], as read at b
        return sum((data[i] + 1) * pow(step, b - 1 - i, mod) for i in range(a, b)) % mod

    golden = 0x9E3779B97F4A7C15
    context = [((value(max(0, i + 1 - pw.WINDOW), i + 1) * golden) % mod) >> 34 for i in range(n)]
    size = 3
    while size * 64 < n:
        size *= 2
    while True:
        ends = [i for i, c in enumerate(context) if c % size == size - 1]
        if size == 3 or len(ends) >= 32:
            break
        size //= 2

    def signature(at):
        out, since = "", 0
        to = [i + 1 for i in at[:63]]
        if not to or to[-1] != n:
            to.append(n)
        for e in to:
            h = value(since, e) * step % mod
            out += chr(pw._ALPHABET[(h * golden % mod) >> 58])
            since = e
        return out

    return f"{size}:{signature(ends)}:{signature([i for i in ends if context[i] % (2 * size) == 2 * size - 1])}"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_fingerprints_match_a_naive_version():
    random.seed(1)
    for n in (0, 1, 6, 7, 8, 50, 300, 900):
        data = bytes(random.randrange(32, 127) for _ in range(n))
        fast, slow = pw.fingerprint(data).split(":"), naive_fingerprint(data).split(":")
        assert fast[0] == slow[0] and [len(x) for x in fast] == [len(x) for x in slow]


def test_common_subsequences():
    random.seed(2)
    pairs = [("".join(random.choice("abcd") for _ in range(random.randint(0, 64))), "".join(random.choice("abcd") for _ in range(random.randint(0, 64)))) for _ in range(200)]
    assert pw.common_subsequence([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [lcs(a, b) for a, b in pairs]


def test_likeness_of_edits_and_strangers():
    texts = [prose(i, 300).encode() for i in range(20)]
    prints = [pw.fingerprint(t) for t in texts]
    edits = [pw.fingerprint(t[: len(t) // 2] + b"an inserted phrase" + t[len(t) // 2 :]) for t in texts]
    assert pw.likeness(prints, edits).min() > 0.8
    assert pw.likeness(prints, prints[1:] + prints[:1]).max() < 0.3
    assert pw.likeness(prints, prints).tolist() == [1.0] * 20


def test_compare_with_next_matches_a_plain_loop(spark, docs):
    rows = sorted(((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["doc_id"]) for r in docs.collect()), key=lambda r: r[:2])
    want = []
    for i, (_, t, d) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        p, q, n = (pw.fingerprint(x.encode()) for x in (t, e, following))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, *np.round(pw.likeness([p, p], [q, n]), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in pw.compare_with_next(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_single_and_empty_tables(spark, empty):
    one = pw.compare_with_next(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    assert pw.compare_with_next(empty).count() == 0


def test_fingerprints_equal_a_naive_version_also_over_pieces(monkeypatch):
    random.seed(5)
    texts = [bytes(random.randrange(32, 127) for _ in range(n)) for n in (1, 6, 7, 8, 50, 300, 900, 4000)] + [b"ab" * 700, b"z" * 500]
    whole = [pw.fingerprint(t) for t in texts]
    assert whole == [naive_fingerprint(t) for t in texts]
    for piece in (64, 100, 512):
        monkeypatch.setattr(pw, "PIECE", piece)
        assert [pw.fingerprint(t) for t in texts] == whole


def test_one_identifier_may_hold_most_rows(spark):
    n = 30_000
    df = spark.range(n).selectExpr("case when id % 3 = 0 then id end as doc_id", "concat('text ', cast(id % 7001 as string), ' of many words') as text", "id as part", "'x' as first")
    got = pw.compare_with_next(df).select("doc_id", "n_chars", "edited_sha256").collect()
    rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect()))
    want = []
    for i, (d, t) in enumerate(rows):
        want.append((d, len(t), hashlib.sha256(pw.edited(t, rows[(i + 1) % n][1]).encode()).hexdigest()))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
