import random

import numpy as np
import xxhash

from strandlake.llm import simhash
from strandlake.llm.common import NULL_ID
from strandlake.llm.components import connected_components


def brute_fingerprint(text, k=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = (text or "").translate(lower).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_near_duplicates_match_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [(NULL_ID if d is None else d, brute_fingerprint(t)) for d, t in rows]
    links = [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 3]
    want = components(links, {a for a, _ in fps})
    got = simhash.near_duplicates(docs).collect()
    assert sorted((NULL_ID if r["doc_id"] is None else r["doc_id"], r["fp"] & (2**64 - 1)) for r in got) == sorted(fps)
    for r in got:
        assert r["component_id"] == (want[NULL_ID if r["doc_id"] is None else r["doc_id"]] if r["doc_id"] is not None or want[NULL_ID] != NULL_ID else None)


def test_linked_within_buckets_of_any_size():
    r = np.random.default_rng(2)
    for radius, width in ((3, 1), (5, 1), (40, 4)):
        centres = r.integers(0, 2**64, (6, width), np.uint64)
        fp = centres[r.integers(0, 6, 300)]
        for _ in range(radius):
            at = r.integers(0, width, 300)
            fp[np.arange(300), at] ^= np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)
        bucket = np.sort(r.integers(0, 9, 300))
        d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
        want = components([(i, j) for i in range(300) for j in range(i) if bucket[i] == bucket[j] and d[i, j] <= radius], range(300))
        assert simhash.link_sorted(fp, bucket, radius).tolist() == [want[i] for i in range(300)]


def test_bands_lose_no_pair():
    random.seed(4)
    for bands in (4, 5, 6):
        keys = simhash.bucket_keys(bands, 3)
        for _ in range(300):
            a = random.getrandbits(64)
            b = a
            for i in random.sample(range(64), 3):
                b ^= 1 << i
            assert any(a & m == b & m for m in keys)


def test_chunks_of_a_hot_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    r = np.random.default_rng(3)
    fps = [int(x) for x in {0b1011 ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(16, 62, (150, 3))}]
    distinct = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp0 long, rep long")
    edges = simhash.links(distinct, [[m] for m in simhash.bucket_keys(4, 3)], 3)
    got = components([tuple(e) for e in edges.collect()], range(len(fps)))
    want = components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(fps)))
    assert got == want


def test_components_of_random_graphs(spark):
    random.seed(6)
    for n, m in ((60, 40), (60, 90), (40, 0)):
        pairs = [(random.randrange(n), random.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 25)]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
        want = components(pairs, {x for p in pairs for x in p})
        touched = {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {k: v for k, v in want.items() if k in touched}


def test_similar_documents_find_edited_copies(spark, docs):
    from tests_llm_prose import prose

    base = [prose(200 + i, 220) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split(" ")
        w[50] = "changed"
        rows.append((100 + i, " ".join(w)))
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: i % 100 for i, _ in rows}


def test_similar_documents_link_at_the_similarity_and_not_below(spark):
    from tests_llm_prose import prose

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1

    rows = []
    for i in range(24):
        base = prose(400 + i, 220).split()
        rows.append((i, " ".join(base)))
        for at in range(20, 20 + 7 * (i % 12 + 1), 7):  # one to twelve edits: similarity 0.95 to 0.57
            base[at] = f"edit{at}"
        rows.append((100 + i, " ".join(base)))
    rows += [(300, "over and over " * 40 + prose(950, 60)), (301, "over and over " * 40 + prose(951, 60)), (302, "one two three four five six"), (303, "one two three four five seven")]
    rows += [(310 + i, prose(960 + i, 60 - i)) for i in range(4)] + [(None, rows[0][1] + " end"), (None, prose(970, 50))]
    sets = [(NULL_ID if i is None else i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if jaccard(x, y) >= 0.8]
    assert any(0.6 < jaccard(x, y) < 0.8 for k, (_, x) in enumerate(sets) for _, y in sets[:k])
    want = components(pairs, {a for a, _ in sets})
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, c in want.items() if i != NULL_ID}


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar_documents(empty).count() == 0


def test_identifiers_do_not_bridge(spark):
    from tests_llm_prose import prose

    a, b = prose(801, 120), prose(802, 120)
    rows = [(1, a), (2, b), (None, a), (None, b), (7, a), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a, 1), (2, b, 2), (7, a, 1), (7, b, 2), (None, a, 1), (None, b, 2)]
    hashes = {r["h"]: r["text"] for r in df.select("text", simhash.row_hash("text").alias("h")).collect()}
    for got in (simhash.near_duplicates(df), simhash.similar_documents(df)):
        by = sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str)
        assert by == sorted(((d, c) for d, _, c in want), key=str)
    assert sorted(((r["doc_id"], hashes[r["row"]], r["component_id"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_one_of_each_keeps_every_text_once(spark):
    from tests_llm_prose import prose

    a, b, c, d = (prose(810 + i, 120) for i in range(4))
    rows = [(7, a, 0), (7, b, 1), (1, a, 2), (9, c, 3), (9, c, 4), (9, c, 5), (None, d, 6), (None, d, 7), (None, a, 8), (None, None, 9), (None, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    kept = [(r["doc_id"], r["text"] or "") for r in simhash.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (7, b), (9, c), (None, d), (None, "")], key=str)
    assert simhash.one_of_each(df).columns == df.columns


def test_pairs_at_the_similarity_are_found(spark):
    """Recall against brute force over pairs of five-word shingle sets, at least 0.9 of those 0.8 alike or more."""
    import os

    import pytest

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = (t or "").translate(lower).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if (len(x & y) / len(x | y) if x | y else 1) >= 0.8]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs and sum(groups[a] == groups[b] for a, b in pairs) >= 0.9 * len(pairs)
    want = components(pairs, [d for d, _ in rows])
    assert all(want[a] == want[b] for a in groups for b in [groups[a]])


def test_shared_shingles_are_counted_for_every_set():
    random = np.random.default_rng(5)
    sets = [np.unique(random.integers(0, 60, size)) for size in (0, 1, 30, 40, 55, 200)]
    held = simhash.SetIndex(np.concatenate(sets), np.array([len(x) for x in sets]))
    for i, x in enumerate(sets):
        mine = held.common(i)
        assert all(mine[j] == len(np.intersect1d(x, y)) or i == j for j, y in enumerate(sets))


def test_clusters_in_many_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "SMALL_CHUNK", 4)
    random = np.random.default_rng(6)
    base = random.choice(10**6, 40, replace=False)
    sets, rows = [], []
    for key in range(60):
        own = base.copy()
        changed = random.choice(40, int(random.integers(0, 9)), replace=False)
        own[changed] = 10**6 + random.integers(0, 10**6, len(changed))
        sets.append(set(own.tolist()))
        fp = simhash._words_of(np.array(sorted(sets[-1]), np.uint64) * np.uint64(simhash._STEP), 1)
        rows.append((7, key, key, len(sets[-1]), int(fp.view(np.int64)[0]), sorted(sets[-1])))
    members = spark.createDataFrame(rows, "cluster long, key long, part long, n int, fp0 long, shingles array<long>")
    found = {(r["a"], r["b"]) for r in simhash.set_links(members, 64, 0.8).collect()}
    alike = {(a, b) for a in range(60) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike and {(max(p), min(p)) for p in found} <= alike

    def groups(pairs):
        root = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(found) == groups(alike)
