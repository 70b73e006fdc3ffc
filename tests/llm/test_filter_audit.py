import re
from itertools import permutations

from strandlake.llm.filter_audit import FILTERS, audit, masks
from tests_llm_prose import prose


def failing(rows):
    """(part, mask) of each (doc_id, text, part)."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, p in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        copy = t in first and (d is None or d > first[t])
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        out.append((p or "", sum(f << k for k, f in enumerate(fails))))
    return out


def brute(rows, labels):
    """Every order applied one filter after another."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    ids = [d for d, _, _ in rows]
    marked = [(p, m, d is not None and d in good, d is not None and d in toxic) for (p, m), d in zip(failing(rows), ids, strict=True)]
    out, shapley = {}, {}
    for part in {p for p, *_ in marked}:
        for order in permutations(range(5)):
            left = [x for x in marked if x[0] == part]
            everyone = list(left)
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1] >> k & 1]
                lost = [x for x in everyone if x[1] >> k & 1]
                left = [x for x in left if not x[1] >> k & 1]
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
                out[part, "".join(FILTERS[j] for j in order), step] = (len(left), len(gone), len(lost) - len(gone), sum(x[1] == 1 << k for x in everyone), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {key: v + (shapley[key[0], FILTERS.index(key[1][key[2] - 1])],) for key, v in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in audit(docs, marks).collect()}
    assert got == brute(rows, labels)


def test_every_order_against_filters_applied_in_turn(spark):
    varied = " ".join(f"w{i}" for i in range(250))
    rows = [(1, varied, "en"), (2, varied, "fr"), (3, varied + " 5%", "en"), (4, "Short TEXT", "en"), (5, "same " * 300, "en"), (6, "", None), (7, None, "en"), (8, " \t\n\x0b ", ""), (9, prose(3, 400), "fr")]
    rows += [(10, "ABC " * 250, "en"), (11, varied, "en"), (12, f"\n{varied} x  y ", "en"), (13, "Ä" * 30 + "A", "en"), (14, prose(5, 6000), "de")]
    check(spark, rows, [(1, 1, 0), (3, 1, 1), (4, 0, 1), (5, None, 1), (10, 1, None), (10, 0, 0), (None, 1, 1), (11, 1, 0)])


def test_no_identifier_repeats_and_copies(spark):
    t = "some text that several hold"
    rows = [(None, t, "en"), (None, t, "en"), (None, t, "fr"), (5, t, "en"), (5, t, "en"), (5, t, None), (9, t, "en"), (None, "alone", "en"), (None, "alone", "fr"), (None, None, "en"), (-3, "alone %", "en")]
    check(spark, rows, [(5, 1, 1), (5, 1, 1), (9, 0, 1)])


def test_words_are_case_sensitive_and_bounds_are_exact(spark):
    rows = [(1, " ".join(f"w{i % 100}" for i in range(200)), "en"), (2, " ".join(f"w{i % 99}" for i in range(200)), "en"), (3, " ".join(["A", "a"] * 100), "en"), (4, "AAA" + "x" * 97, "en"), (5, "AAAA" + "x" * 97, "en")]
    check(spark, rows, [])


def test_empty_and_clashing_columns(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit(empty, labels).count() == 0
    more = docs.selectExpr("*", "1 as word", "2 as id", "'x' as h1", "3 as mask", "4 as n_")
    assert sorted(audit(more, labels.limit(0)).collect()) == sorted(audit(docs, labels.limit(0)).collect())
    assert masks(docs, labels).agg({"n": "sum"}).first()[0] == docs.count()
