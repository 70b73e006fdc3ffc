import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm import language_model as lm
from strandlake.llm.common import fold


def test_base_scores_counts_and_gain(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    keep = ~fold("doc_id", 7, 2)
    train = [r["text"] for r in docs.where(keep).collect()]
    c = Counter()
    for t in train:
        c.update(lm.tokens(t))
    n, v = sum(c.values()), len(c)
    out = lm.score(docs, lm.train(docs, keep)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = lm.tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] <= 0
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_of_all_words_add_up(spark):
    docs = spark.createDataFrame([(i, f"the cat w{i % 5} sat on the mat and x{i} ran. xyz{i}") for i in range(40)], "doc_id long, text string")
    model = lm.train(docs, F.lit(True))
    lex = model.lexicon
    known = {r["h"]: r["c"] for r in model.counts.collect()}
    every = np.arange(lm.CLASSES)
    words = sorted({w for r in docs.collect() for w in lm.tokens(r["text"])})
    h = np.array(sorted(known))
    c = np.array([known[x] for x in h])
    for context in ((b"on", b"the"), (lm.END, b"cat"), (lm.END, lm.END)):
        far, near = lex.classes(list(context))
        p = np.exp(lex.log_p(far, near, every))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)
        total = 0.0
        for w in words:
            (cls,) = lex.classes([w])
            within = 1.0 if cls < lm.FREQUENT else (known[lm.word_hash(w)] + 1) / math.exp(lex.rest[cls - lm.FREQUENT])
            total += p[cls] * within
        # One share of each class of endings stands for words that training did not meet; unused classes of frequent words hold none.
        rest = sum(p[lm.FREQUENT + j] / math.exp(lex.rest[j]) for j in range(lex.endings))
        unused = p[len(lex.by_hash) : lm.FREQUENT].sum() + p[lm.FREQUENT + lex.endings :].sum()
        assert math.isclose(total + rest + unused, 1, rel_tol=1e-9)
    n, k, base, score = lm._score_texts(["the cat", None, "unheard words"], lex, h, c)
    assert n.tolist() == [3, 1, 3] and k.tolist() == [3, 1, 1]
    ids = lex.classes([lm.END, lm.END, b"the", b"cat", lm.END])
    want = sum(lex.log_p(*x) for x in zip(ids, ids[1:], ids[2:], strict=False))
    want += sum(0 if i < lm.FREQUENT else math.log(known[lm.word_hash(w)] + 1) - lex.rest[i - lm.FREQUENT] for i, w in zip(ids[2:], (b"the", b"cat", lm.END), strict=True))
    assert math.isclose(score[0], want / math.log(10))


def test_run_counts(spark):
    texts = [("a b a",), (None,), ("",), ("b",), ("a b",)]
    docs = spark.createDataFrame(texts, "text string").withColumn("doc_id", F.monotonically_increasing_id())
    lex = lm.train(docs, F.lit(True)).lexicon
    want = Counter()
    for (t,) in texts:
        ids = lex.classes([lm.END, lm.END, *lm.tokens(t)])
        want.update((a * lm.CLASSES + b) * lm.CLASSES + c for a, b, c in zip(ids, ids[1:], ids[2:], strict=False))
    for df in (docs.select("text"), docs.select("text").coalesce(1)):
        assert {r["run"]: r["n"] for r in lm.run_counts(df, lex).collect()} == want


def test_noise_contrastive_estimates_approach_the_shares():
    r = np.random.default_rng(1)
    n = r.integers(1, 200, (1, 12, 12)).astype(float)
    runs = np.stack([x.ravel() for x in np.indices(n.shape)], 1)
    share = n.sum((0, 1)) / n.sum()
    model = lm.BilinearModel(share, dimensions=12)
    for k in range(2500):
        model.train(runs, n.ravel(), np.random.default_rng(k), n.mean(), 0.3 / (1 + k / 100))
    far, near, norm = model.tables()
    got = np.exp(far[0][None] + near - norm[0][:, None])
    assert np.abs(got - n[0] / n[0].sum(1, keepdims=True)).max() < 0.03


def test_gradient_is_that_of_the_objective():
    """One step of plain ascent from fixed noise, against differences of the objective."""
    share = np.array([0.4, 0.3, 0.2, 0.1])
    runs, n = np.array([[0, 1, 2], [3, 1, 0], [2, 2, 1]]), np.array([2.0, 1.0, 3.0])
    model = lm.BilinearModel(share, dimensions=3)
    drawn = np.minimum(np.searchsorted(np.cumsum(model.noise), np.random.default_rng(5).random(lm.DRAWN)), 3)

    def objective(context, target, position, bias):
        v = context[runs[:, 0]] * position[0] + context[runs[:, 1]] * position[1]
        log_noise = np.log(lm.NOISE * model.noise)
        odds = (v * target[runs[:, 2]]).sum(1) + bias[runs[:, 2], 0] - log_noise[runs[:, 2]]
        against = v @ target[drawn].T + bias[drawn, 0] - log_noise[drawn]
        weight = n / (n.mean() * 3)
        return (weight * (-np.log1p(np.exp(-odds)) - lm.NOISE / lm.DRAWN * np.log1p(np.exp(against)).sum(1))).sum()

    seen = {}
    model._step = lambda which, rows, g, rate: seen.__setitem__(which, (rows, g))
    start = [p.astype(np.float64) for p in model.parameters()]
    model.train(runs, n, np.random.default_rng(5), n.mean())
    for which, (rows, g) in seen.items():
        got = np.zeros_like(start[which])
        np.add.at(got, rows, g)
        for at in np.ndindex(got.shape):
            up, down = [p.copy() for p in start], [p.copy() for p in start]
            up[which][at] += 1e-5
            down[which][at] -= 1e-5
            assert math.isclose(got[at], (objective(*up) - objective(*down)) / 2e-5, rel_tol=1e-3, abs_tol=1e-4)


def test_clashing_columns_and_rows_of_one_identifier_or_none(spark):
    rows = [(None, "the cat sat"), (None, "the dog sat"), (4, "the cat sat"), (4, "a long text " * 3000), (4, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4.0, "s") for i, t in rows], "doc_id long, text string, n_tokens int, n_known int, train_tokens int, base_score double, score string")
    out = lm.score(df, lm.train(df, F.lit(True))).collect()
    assert len(out) == 5 and sorted(r["n_tokens"] for r in out) == [1, 4, 4, 4, 9001]
    assert {r["score"] for r in out if r["text"] == "the cat sat"}.__len__() == 1


def test_empty_tables(docs, empty):
    model = lm.train(empty, F.lit(True))
    assert lm.score(empty, model).count() == 0
    r = lm.score(docs.where("doc_id = 1"), model).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0.0


def test_numbered_words_are_the_tokens_and_shares_keep_the_order():
    texts = ["", None, " Ab  c\x0b\x0cAB ", "\t\n", "x", "\u00e9 \u00c9\u00a0Z q\x1cw\x85k zz", "a b\n" * 50, "long" * 30]
    whole = [list(map(lm.tokens, texts)), [t for x in texts for t in lm.tokens(x)]]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut", *texts], kind).slice(1)
        for before in (0, 2):
            ids, sizes, words = lm.numbered(column, before)
            cuts = np.cumsum(sizes)[:-1]
            got = [[words[i].as_py() for i in part] for part in np.split(ids, cuts)]
            assert got == [[lm.END] * before + t for t in whole[0]]
        assert lm.word_hashes(words).tolist() == [lm.word_hash(w) for w in words.to_pylist()]
        assert lm.word_endings(words).tolist() == [lm.ending(w) for w in words.to_pylist()]
        for size in (1, 7, 40, 1 << 20):
            parts = list(lm.shares([column.slice(0, 3), column.slice(3, 0), column.slice(3)], size))
            assert [t for p in parts for t in p.to_pylist()] == texts and all(len(p) for p in parts)
            assert max(sum(len((t or "").encode()) for t in p.to_pylist()[:-1]) for p in parts) <= size
    assert list(lm.shares([pa.array([], pa.string())])) == [] and len(lm.numbered(pa.array([], pa.string()))[0]) == 0


def test_gradients_add_up_by_class():
    r = np.random.default_rng(3)
    model = lm.BilinearModel(np.full(50, 0.02), dimensions=4)
    classes, rows = r.integers(3, 40, 300), r.normal(size=(300, 4)).astype(np.float32)
    want = np.zeros((50, 4))
    np.add.at(want, classes, rows)
    assert np.abs(model._class_sums(classes, rows) - want).max() < 1e-4
