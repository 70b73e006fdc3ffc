import random

import pytest

from strandlake.llm import token_counts
from strandlake.llm.token_counts import LengthTable, TokenCounter, count_tokens
from tests_llm_prose import prose

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
PARTS = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "B", "é", "1", "²", "٠", "Ⅷ", "_", "-", "!", "<|endoftext|>", "<|", "\0", "日本", "ǅ", "́", "‍", "😀", "it", "s", "x'sy", "\U0001e030", "w" * 40]


def library(texts, name="byte_bpe_50k.json"):
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_cutting_and_both_tiers_equal_the_library():
    texts = odd_texts(3000)
    want = library(texts)
    counter = TokenCounter(PATH)
    assert counter.cutter is not None
    assert counter.count(texts).tolist() == want
    counter.table = LengthTable(1 << 10)
    words = [b"a", b" it", b"\0", b"\0\0", b"'s", b"'ve", " é".encode(), b"  "]
    counter.table.fill(words, counter.lengths(words))
    assert counter.count(texts).tolist() == want


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    texts = [" ".join(odd_texts(300, 2)), "x" * 5000, prose(3, 900), "", "a. \n\n b", "no end of spaces" + " " * 300 + "x"]
    assert TokenCounter(PATH).count(texts).tolist() == library(texts)


def test_cache_forgets_and_table_is_exact(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    counter = TokenCounter(PATH)
    texts = [prose(i, 60) for i in range(20)]
    assert counter.count(texts).tolist() == library(texts) and counter.count(texts).tolist() == library(texts)
    assert len(counter.known) < 200
    table = LengthTable(1 << 8)
    words = [bytes([65 + i % 26, 65 + i // 26]) * (1 + i % 8) for i in range(120)]
    table.fill(words, list(range(1, 121)))
    data = b"".join(words) + b"AB"
    import numpy as np

    size = np.array([len(w) for w in words] + [2])
    low, high = token_counts.keys_of(data, np.cumsum(size) - size, size)
    assert table.find(low, high, size).tolist()[:-1] == list(range(1, 121))
    assert table.find(low, high, size + 1).max() <= 120


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tables_of_odd_rows(docs, name):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted(zip([str(d) for d, _ in rows], [len(t.encode()) for _, t in rows], library([t for _, t in rows], name), strict=True))
    got = count_tokens(docs.selectExpr("*", "'x' as n_tokens", "1 as `OVER_LIMIT`"), name)
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    got = got.collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got) and any(r["over_limit"] for r in got)


def test_empty_table_and_no_text_at_all(spark, empty):
    assert count_tokens(empty).count() == 0
    got = count_tokens(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(0, 0, False)] * 2


def test_query_on_a_whole_table(spark):
    from strandlake.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = QUERIES["op12_token_counts"](spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    got = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert got == dict(zip(texts, library(list(texts.values())), strict=True))
