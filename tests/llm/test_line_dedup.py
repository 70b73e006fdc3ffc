import hashlib

import numpy as np

from strandlake.llm.common import NULL_ID, SPACE
from strandlake.llm.line_dedup import dedup_lines
from strandlake.llm.perfect_hash import MinimalPerfectHash


def brute(rows, min_chars=10):
    """{row number: (n_lines, n_dropped, kept text)}"""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(lower)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(NULL_ID if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (NULL_ID if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_brute_force_and_keeps_columns(docs):
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "block", "fp", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {(r["block"], r["fp"]) for r in out.collect()} == {("b", 6)}


def test_spaces_case_short_lines_and_ties(spark):
    rows = [(5, "  Same LINE here \nshort\nÉtoile du nord"), (2, "same line here\nshort\nétoile du nord\nsame line here"), (9, "SAME LINE HERE\t\x0b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df).collect()}
    assert got == {2: (4, 0, rows[1][1]), 5: (3, 1, "short\nÉtoile du nord"), 9: (1, 1, "")}


def test_empty_table(empty):
    assert dedup_lines(empty).count() == 0


def test_query_digest(docs):
    text = dedup_lines(docs).where("doc_id = 102").first()["text"]
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_perfect_hash_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = r.integers(0, 2**64, n, np.uint64), r.integers(0, 2**64, n, np.uint64)
        h = MinimalPerfectHash(a, b)
        assert sorted(h.lookup(a, b).tolist()) == list(range(n))
    other = h.lookup(a ^ np.uint64(1), b)
    assert other.max() < n and other.min() >= -1


def test_rows_without_identifier_or_of_one_are_one_document(spark):
    shared = "a line that many rows hold"
    rows = [(None, f"{shared}\nonly here number {i}") for i in range(40)] + [(3, f"{shared}\nthree has line {i}") for i in range(20)] + [(9, "only here number 7\nthree has line 4\na line of nine only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df).collect()), key=str)
    assert got == brute(rows)
    nobody = [r for r in rows if r[0] is None]
    got = dedup_lines(spark.createDataFrame(nobody, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in nobody)


def test_index_of_repeated_rows_and_its_written_form():
    from strandlake.llm.line_dedup import LineIndex

    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**64, 3000, np.uint64), r.integers(0, 2**64, 3000, np.uint64)
    pick = r.integers(0, 3000, 20_000)
    ids = r.integers(0, 50, 20_000)
    index = LineIndex.from_arrow(LineIndex(a[pick], b[pick], ids, ids).to_arrow(0))
    count, first = index.probe(a, b)
    for i in range(3000):
        own = ids[pick == i]
        assert count[i] == min(2, len(set(own.tolist()))) and (not len(own) or first[i] == own.min())
    assert not index.probe(a, b ^ np.uint64(1))[0].any()
