import zlib

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import quality, toxicity, url_filter
from strandlake.llm.common import fold
from strandlake.llm.labelled import training_sample
from tests_llm_prose import prose


def junk(seed):
    return "\n".join(" ".join(w + "%%%" for w in line.split()) for line in prose(seed, 60).split("\n"))


def labelled(spark, n=120):
    rows = [(i, prose(i, 60) if i % 3 else junk(i), int(i % 3 > 0)) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, "", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_quality_separates_held_out_documents(spark):
    docs, labels = labelled(spark)
    held = fold("doc_id", 5, 0)
    model = quality.train(docs, labels, ~held)
    out = quality.score_documents(docs, model).join(labels.withColumnRenamed("quality", "y"), "doc_id").where(held & (F.length("text") > 0)).collect()
    assert len(out) > 15
    assert all((r["quality"] >= 0.3) == bool(r["y"]) for r in out)


def test_marginals_match_enumeration():
    r = np.random.default_rng(0)
    f = quality.LineField(3)
    f.w, f.move = r.normal(size=3), r.normal(size=(2, 2))
    counts = np.array([1, 4, 2, 5])
    x = r.normal(size=(counts.sum(), 3))
    p, pairs = f.marginals(x, counts, True)
    want, trans, at = [], np.zeros((2, 2)), 0
    for n in counts:
        e = x[at : at + n] @ f.w
        at += n
        z, good, tr = 0.0, np.zeros(n), np.zeros((2, 2))
        for m in range(2**n):
            y = [(m >> i) & 1 for i in range(n)]
            s = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(f.move[y[i], y[i + 1]] for i in range(n - 1)))
            z += s
            good += s * np.array(y)
            for i in range(n - 1):
                tr[y[i], y[i + 1]] += s
        want.extend(good / z)
        trans += tr / z
    assert np.allclose(p, want) and np.allclose(pairs, trans)


def test_quality_edge_cases(spark, docs, empty):
    model = quality.QualityModel.fit([])
    out = quality.score_documents(docs.withColumn("accepted", F.lit("old")), model)
    assert out.count() == docs.count() and {r["quality"] for r in out.collect()} == {0.5}
    assert dict(out.dtypes)["accepted"] == "boolean"
    assert quality.score_documents(empty, model).count() == 0
    one = quality.QualityModel.fit([("good text here", 1)] * 3)
    assert one.score(["x", None]).tolist() == [1.0, 1.0]
    fitted = quality.train(*labelled(spark), F.lit(True))
    scores = fitted.score([None, "", " ", prose(5, 40), "é" * 5000])
    assert ((scores >= 0) & (scores <= 1)).all() and scores[0] == scores[1]


def test_gradient_of_noisy_or_learns_words_and_finds_sentences(spark):
    rows = []
    for i in range(160):
        t = prose(i, 70)
        if i % 4 == 0:
            parts = t.split(". ")
            parts.insert(2, f"you are a complete {['muppet', 'wazzock'][i % 8 == 0]} really")
            t = ". ".join(parts)
        rows.append((i, t, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = fold("doc_id", 3, 1)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), ~held)
    out = toxicity.score_documents(df, model).where(held).collect()
    assert all((r["toxicity"] >= 0.7) == bool(r["toxic"]) for r in out)
    for r in out:
        found = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
        assert all("muppet" in f or "wazzock" in f for f in found) and bool(found) == bool(r["toxic"])


def test_toxicity_edge_cases(docs, empty):
    model = toxicity.ToxicityModel.fit([("all fine", 0)])
    assert {r["toxicity"] for r in toxicity.score_documents(docs, model).collect()} == {0.0}
    assert toxicity.score_documents(empty, model).count() == 0
    m = toxicity.ToxicityModel(-3.0, {"=bad": 6.0})
    assert m.score(None)[0] == 0.0 and m.score(" \n ")[0] == 0.0
    p = [1 / (1 + np.exp(3.0)), 1 / (1 + np.exp(-3.0))]
    assert np.isclose(m.score("fine words. bad words!")[0], 1 - (1 - p[0]) * (1 - p[1]))
    assert toxicity.sentences("One. Two!\n\n Three") == [(0, 4), (4, 9), (11, 17)]


def brute_rule(host, path):
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_urls_rules_and_edge_cases(spark):
    urls = ["http://A.Example.com/en/7x?q", "http://a.example.com/en/6", "https://example.net/de/8", "https://example.net/de/9#x", "x.org/es/1", None, "", "ftp://m.Sub.ORG/es/", "https://cheap-pills.example.com/fr/1",
            "http://org/es/?a", "http://notexample.com/en/71", "a://b://c/d", "http://h?x/y", "http://h#f", "http://ünï.com/en/é"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    rows = url_filter.judge_urls(df).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        host, path = url_filter.split_url(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        rule = brute_rule(host, path)
        assert r["rule"] == (rule and rule[0]) and r["verdict"] == (rule[1] if rule else "block" if r["score"] >= 0.5 else "allow")
    by = {r["url"]: r for r in rows}
    assert by["x.org/es/1"]["host"] == "" and by["a://b://c/d"]["host"] == "b:" and by["https://cheap-pills.example.com/fr/1"]["verdict"] == "block"
    assert by["http://h?x/y"]["path"] == "" and by["http://A.Example.com/en/7x?q"]["rule"] == "example.com/en/7"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_model_on_unseen_hosts():
    m = url_filter.UrlModel.fit(url_filter.labelled_urls())
    score = lambda u: m.score(*url_filter.split_url(u))
    assert min(score(f"https://{w}.example.org/en/5") for w in ("cheap-loans", "spam-farm", "casino-win", "pills-bonus")) > 0.5
    assert max(score(f"https://{w}.example.org/en/5") for w in ("thering", "blog.moonriver", "m.tiontion", "www.history-news")) < 0.5


def test_training_rows_are_fixed_for_repeated_identifiers(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0)], "doc_id long, quality int")
    got = [training_sample(x, labels, "quality", F.lit(True), 12, 100) for x in (docs, docs.repartition(7).orderBy(F.desc("text")))]
    assert got[0] == got[1] and len(got[0]) == 12 and len({t for t, _ in got[0]}) == 12


def test_url_model_on_hosts_it_did_not_learn_from():
    table = url_filter.labelled_urls()
    split = [zlib.crc32(url_filter.split_url(u)[0].encode()) % 2 for u, _ in table]
    model = url_filter.UrlModel.fit([x for x, s in zip(table, split, strict=True) if s])
    held = [(model.score(*url_filter.split_url(u)) >= url_filter.BLOCK_FROM, bool(y)) for (u, y), s in zip(table, split, strict=True) if not s]
    right = sum(a == b for a, b in held) / len(held)
    print("held-out accuracy", right, "of", len(held))
    assert right > 0.8
