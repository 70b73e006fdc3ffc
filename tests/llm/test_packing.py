import itertools
import random
import zlib

import numpy as np
import pytest

from strandlake.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.resolve_vocabulary("word_bpe_49k.json"))


def test_words_have_the_ids_of_whole_texts():
    random.seed(3)
    letters = ["a", "B", "é", "é", "J̌", " ", "\n", "\t", "  ", "\x1c", "\x85", " ", "0", "9", "٠", "'s", "'", "<|endoftext|>", "!", ",", ".", "Σ", "ß", "漢", "😀", "‍", "İ", "the", "Word"]
    whole, words = tokenizer(), packing.WordTokenizer(packing.resolve_vocabulary("word_bpe_49k.json"))
    for _ in range(800):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(words.encode(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    words, whole = packing.WordTokenizer(packing.resolve_vocabulary("word_bpe_49k.json")), tokenizer()
    texts = [f"word{i} other{i % 7}, plain." for i in range(200)]
    assert all(np.frombuffer(words.encode(t), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_vocabularies_of_other_kinds_encode_whole_texts():
    from tokenizers import Tokenizer

    path = packing.resolve_vocabulary("byte_bpe_50k.json")
    words, whole = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert not words.by_word and packing.WordTokenizer(packing.resolve_vocabulary("word_bpe_49k.json")).by_word
    for text in ("", "The  Cat\nsat.", " two Words é 12!", "\t"):
        assert np.frombuffer(words.encode(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_feasible_and_near_the_bound(seed):
    random.seed(seed)
    cap = 60
    counts = {}
    for _ in range(400):
        k = random.choice([cap, random.randint(1, cap), random.randint(1, 12)])
        counts[k] = counts.get(k, 0) + 1
    plan = packing.plan_bins(counts, cap)
    used = {}
    for sizes, times in plan:
        assert sum(sizes) <= cap and times > 0
        for s in sizes:
            used[s] = used.get(s, 0) + times
    assert used == counts
    bins, total = sum(t for _, t in plan), sum(k * v for k, v in counts.items())
    assert bins <= -(-total // cap) + 1


def test_plan_matches_the_best_of_small_cases():
    def best(items, cap):
        for n in range(1, len(items) + 1):
            for places in itertools.product(range(n), repeat=len(items)):
                load = [0] * n
                for i, p in zip(items, places, strict=True):
                    load[p] += i
                if max(load) <= cap:
                    return n
        return 0

    random.seed(5)
    for _ in range(25):
        items = [random.randint(1, 10) for _ in range(6)]
        counts = {k: items.count(k) for k in items}
        assert sum(t for _, t in packing.plan_bins(counts, 10)) == best(items, 10)
    assert packing.plan_bins({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, 10)


def test_pieces_places_and_round_trip(docs):
    whole = tokenizer()
    out = packing.pack(docs, keep_ids=True, capacity=256)
    rows = out.collect()
    expected = {}
    for r in docs.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            key = (r["doc_id"], k // 256, k, tuple(ids[k : k + 256]))
            expected[key] = expected.get(key, 0) + 1
    got = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], np.uint32)
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["length"] == len(ids)
        key = (r["doc_id"], r["piece"], r["start"], tuple(ids.tolist()))
        got[key] = got.get(key, 0) + 1
    assert got == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in rows) // 256) + 1
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    assert {k: len(v) for k, v in joined.items()} == {k: 4 * sum(p[1] for p in v) for k, v in by.items()}


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0
