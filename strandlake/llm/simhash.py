"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a few bits.

Method. Texts with equal fingerprints meet first, so that copies cost nothing more.
Distinct fingerprints are dealt to buckets that share enough of their bits: with
b bands and radius r, two fingerprints within r bits agree on at least b - r bands, so
every pair within the radius meets in some bucket. In a bucket the fingerprints
lie as vertical bit planes: 64 comparisons a machine word. Distances of all rows
to the row s places on grow in carry-save counters, plane by plane; words all of whose
lanes have passed the radius are abandoned. Links are kept as a spanning forest.
Buckets beyond ``CHUNK`` rows are split into pairs of chunks, dealt to many tasks: the
same comparisons, with no cap.

:func:`near_duplicates` links 64-bit fingerprints within a few bits, and loses no link.
:func:`similar_documents` is for a similarity of shingle sets, at which many more bits differ: it takes
wider fingerprints of the sets, and buckets by tables of sampled bits, as many as it takes to bring
a pair of just that similarity together with probability ``RECALL``. Those are candidates: a link is
a pair whose hashed shingle sets were compared and are that similar. Near copies are found and linked
first by a few tables. What candidates of different groups span makes clusters; the sets of a cluster are
dealt to pairs of its chunks, and the pairs within the radius are compared there, so no table holds pairs.

Defined cases: null, empty or blank text has fingerprint zero and is linked like any
other. Links are between fingerprints, never by identifier: rows that share one, or have none, are linked
only if their texts are. A component is named by its smallest identifier; one of rows without any has none. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.components import connected_components
from strandlake.llm.perfect_hash import mix
from strandlake.session import materialize, ship

BITS = 64
#: 64-bit words of a wide fingerprint; chance that a pair of just the wanted similarity meets.
WIDE, RECALL = 4, 0.98
#: Tables by which near copies meet before all other pairs.
FIRST_TABLES = 8
#: Documents up to which identifiers are broadcast.
BROADCAST_IDS = 1_000_000
#: Rows of a bucket that one task compares; larger buckets are split.
CHUNK = 512
#: Rows that a task's groups of buckets hold, about.
GROUP_ROWS = 40_000
#: Shingles of a chunk and of a task's groups, about, where sets are compared; rows below which a cluster is not split.
CHUNK_SHINGLES, GROUP_SHINGLES, SMALL_CHUNK = 1_000_000, 4_000_000, 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONES_INT = 0xFFFFFFFFFFFFFFFF
_STEP = 0x9E3779B97F4A7C15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned: a bit is 1 if it is set in over half of the shingles' XXH64."""
    return int(wide_fingerprint(text, words, seed, 1)[0])


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle; of the whole sequence where it is shorter; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(b" ".join(tokens), seed)] if n else [], np.uint64)
    joined = b" ".join(tokens)
    start, at = [0] * n, 0
    for i, w in enumerate(tokens):
        start[i] = at
        at += len(w) + 1
    ends = start[words:]
    ends.append(at)
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(start, ends, strict=False)], np.uint64)


def wide_fingerprint(text: str | None, words: int, seed: int, size: int) -> np.ndarray:
    """``size`` words: the first of the shingles' hashes, the others of hashes made from those."""
    hashes = shingle_hashes(text, words, seed)
    return _words_of(hashes, size)


def _words_of(hashes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    for i in range(size if len(hashes) else 0):
        out[i] = majority(mix(hashes + np.uint64(i * _STEP & _ONES_INT)) if i else hashes)
    return out


def set_sketch(text: str | None, words: int, seed: int, size: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The set of a text's shingle hashes, its key, and its fingerprint of ``size`` words."""
    shingles = np.unique(shingle_hashes(text, words, seed))
    return shingles, xxhash.xxh64_intdigest(shingles.tobytes(), seed), _words_of(shingles, size)


def majority(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, doc_id: str, words: int = 3, seed: int = 42, size: int = 1) -> DataFrame:
    """(doc_id long, fp0, fp1, ... long: the fingerprint's words as signed numbers)."""
    ship(docs.sparkSession)
    names = [f"fp{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([wide_fingerprint(x, words, seed, size) for x in batch.column(1).to_pylist()], np.uint64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T)], names=["doc_id", *names])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def row_hash(text: str) -> Column:
    """Tells rows of one identifier apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def set_fingerprints(docs: DataFrame, text: str, doc_id: str, words: int, seed: int, size: int) -> DataFrame:
    """(doc_id, row, fp0, ..., key, n): a hash of the text; fingerprint, key and size of its shingle set."""
    ship(docs.sparkSession)
    names = [*(f"fp{i}" for i in range(size)), "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_sketch(x, words, seed, size) for x in batch.column(2).to_pylist()]
            rows = np.array([[*fp.tolist(), key] for _, key, fp in found], np.uint64).reshape(-1, size + 1)
            longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.array([len(x) for x, _, _ in found], pa.int32())], names=["doc_id", "row", *names, "n"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_hash(text).alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "row long", *(f"{n} long" for n in names), "n int"]))


def shingle_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(key, shingles) of ``docs`` (id, text), a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_sketch(x, words, seed, 0) for x in batch.column(0).to_pylist()]
            keys = np.array([key for _, key, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.view(np.int64) for x, _, _ in found], pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key long, shingles array<long>")


def bands_for(n: int, radius: int) -> int:
    """Bands so that a bucket of unrelated fingerprints holds few of ``n``; any number is exact."""
    bands = radius + 1
    while bands < radius + 3 and n > 64 * 2 ** (BITS * (bands - radius) // bands):
        bands += 1
    return bands


def bucket_keys(bands: int, radius: int) -> list[int]:
    """A mask for each choice of bands that a pair within the radius may agree on."""
    edges = [BITS * i // bands for i in range(bands + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    return [sum(parts[i] for i in c) for c in combinations(range(bands), bands - radius)]


class _Forest:
    """Union-find over row numbers; the smallest is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def link_sorted(fp: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """Root of each row, where rows of a bucket (contiguous) within ``radius`` bits are linked."""
    forest = _Forest(len(fp))
    for i, j in pairs_sorted(fp, bucket, radius):
        forest.unite(i, j)
    return forest.root


def pairs_sorted(fp: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of a bucket (contiguous) within ``radius`` bits, by how far apart they lie.

    ``fp``: a row of 64-bit words each. Counters are as wide as the radius needs, and start
    so that they overflow just beyond it.
    """
    n, bits_in_all = len(fp), BITS * fp.shape[1]
    width = max(1, int(radius).bit_length())
    head_start = (1 << width) - 1 - radius
    if n < 2:
        return
    words = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = np.zeros((bits_in_all, words + 2), np.uint64)
    padded = np.zeros((bits_in_all, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes[:, :words] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the bucket from this one on
    for s in range(1, int(sizes.max())):
        lanes = np.zeros(words * 64, np.uint8)
        lanes[:n] = left > s
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        at = np.flatnonzero(valid)
        counters = [np.full(len(at), _ONES if head_start >> k & 1 else 0, np.uint64) for k in range(width)]
        over = np.zeros(len(at), np.uint64)
        q, r = divmod(s, 64)
        for first in range(0, bits_in_all, 8):
            here = planes[first : first + 8]
            x = here[:, at + q] >> np.uint64(r)
            if r:
                x |= here[:, at + q + 1] << np.uint64(64 - r)
            x ^= here[:, at]
            for carry in x:
                for k in range(width):
                    carry, counters[k] = counters[k] & carry, counters[k] ^ carry
                over |= carry
            alive = (valid[at] & ~over) != 0
            if not alive.all():
                at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
                if not len(at):
                    break
        if len(at):
            hit = np.unpackbits((valid[at] & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lane, bit = np.nonzero(hit)
            i = at[lane] * 64 + bit
            yield i, i + s


def tables_for(n: int, similarity: float) -> list[list[int]]:
    """Masks of sampled bits (by word): tables in which a pair of that similarity meets with chance ``RECALL``.

    Shingle sets of equal size and Jaccard similarity j are at the angle acos(2 j / (1 + j)), of which the
    share 1 / pi is the chance that a bit differs.
    """
    same = 1 - differing(similarity)
    bits = max(10, int(math.log2(max(n, 2))) - 4)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - same**bits))
    random = np.random.default_rng(11)
    out = []
    for _ in range(tables):
        mask = [0] * WIDE
        for b in random.choice(BITS * WIDE, bits, replace=False).tolist():
            mask[b // BITS] |= 1 << b % BITS
        out.append(mask)
    return out


def differing(similarity: float) -> float:
    """The greatest chance that a bit of two sets' fingerprints differs: by the angle, or counted out for small sets."""

    def counted(both: int, x: int, y: int) -> float:
        ways = sum(
            math.comb(both, k) * math.comb(x, u) * math.comb(y, v)
            for k in range(both + 1) for u in range(x + 1) for v in range(y + 1)
            if (2 * (k + u) > both + x) != (2 * (k + v) > both + y)
        )
        return ways / 2 ** (both + x + y)

    small = [counted(both, x, n - both - x) for n in range(1, 13) for both in range(1, n) if both / n >= similarity for x in range(n - both + 1)]
    return max([math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi, *small])


def _forest_links(fp: np.ndarray, bucket: np.ndarray, radius: int, columns: dict) -> tuple[np.ndarray, np.ndarray]:
    root = link_sorted(fp, bucket, radius)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def _candidates(similarity: float):
    """As many pairs as span the groups of those whose sizes allow the similarity, of different ``part``s if there are parts."""

    def choose(fp: np.ndarray, bucket: np.ndarray, radius: int, columns: dict) -> tuple[np.ndarray, np.ndarray]:
        part = columns.get("part")
        forest, out = _Forest(len(fp)), [np.zeros((2, 0), np.int64)]
        for i, j in pairs_sorted(fp, bucket, radius):
            fits = _sizes_allow(columns["n"], i, j, similarity) & (forest.root[i] != forest.root[j])
            if part is not None:
                fits &= part[i] != part[j]
            i, j = i[fits], j[fits]
            forest.unite(i, j)
            out.append(np.stack([i, j]))
        return tuple(np.concatenate(out, 1))

    return choose


def _sizes_allow(n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6


def links(distinct: DataFrame, masks: list[list[int]], radius: int, choose=_forest_links, more: tuple[str, ...] = (), across: bool = True) -> DataFrame:
    """Spanning links (a, b) of (fp0.., rep): reps of fingerprints within ``radius`` bits that share bits under a mask.

    ``choose`` may name other pairs, by the columns ``more`` too. Buckets of a single ``part`` are left out.
    Without ``across``, rows of a large bucket meet those of their own chunk only; each mask deals other chunks.
    """
    fps = [c for c in distinct.columns if c.startswith("fp")]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(signed(m)) for c, m in zip(fps, mask, strict=True) if m]) for t, mask in enumerate(masks)]
    spread = distinct.select(*fps, "rep", *more, F.explode(F.array(*keys)).alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *([F.min("part").alias("p"), F.max("part").alias("q")] if "part" in more else [])).where("n > 1")
    sizes = sizes.where("p < q") if "part" in more else sizes
    sizes = materialize(sizes.select("bucket", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "buckets")
    # A bucket's rows go to each of its chunk pairs that they are part of.
    kept, dealt_rows = sizes.agg(F.count(F.lit(1)), F.sum(F.col("n") * (F.col("chunks") if across else F.lit(1)))).first()
    groups = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(dealt_rows or 0) // GROUP_ROWS))
    sizes = sizes.select("bucket", "chunks")
    own = F.pmod(F.xxhash64("bucket", *fps), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1) if across else F.array("own")
    pairs = F.transform(others, lambda j: F.xxhash64(F.col("bucket"), F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    # Most fingerprints are alone in their buckets: those leave before any shuffle where the others' buckets are few.
    met = spread.join(F.broadcast(sizes) if kept <= BROADCAST_IDS else sizes, "bucket")
    dealt = met.withColumn("own", own).select(*fps, "rep", *more, F.explode(pairs).alias("bucket"))
    dealt = dealt.withColumn("deal", F.pmod("bucket", F.lit(groups)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        rep, bucket = (table.column(c).to_numpy() for c in ("rep", "bucket"))
        fp = np.stack([table.column(c).to_numpy() for c in fps], 1).view(np.uint64)
        order = np.argsort(bucket, kind="stable")
        fp, rep, bucket = fp[order], rep[order], bucket[order]
        i, j = choose(fp, bucket, radius, {c: table.column(c).to_numpy()[order] for c in more})
        if choose is not _forest_links:
            i, j = np.unique(np.sort(np.stack([rep[i], rep[j]]), axis=0), axis=1)
            return pa.table({"a": pa.array(i), "b": pa.array(j)})
        return pa.table({"a": pa.array(rep[i]), "b": pa.array(rep[j])})

    return dealt.groupBy("deal").applyInArrow(compare, "a long, b long").distinct()


def _components(fps: DataFrame, node: str, edges_of) -> DataFrame:
    """``fps`` with root (least node of the component) and component_id; ``edges_of`` links rows of one ``node`` each, their rep."""
    others = [c for c in fps.columns if c not in ("doc_id", "row", node)]
    nodes = fps.groupBy(node).agg(*[F.first(c).alias(c) for c in others], F.min(F.struct(F.col("doc_id").isNull().alias("none"), *[c for c in ("doc_id", "row") if c in fps.columns])).alias("least"))
    distinct = materialize(nodes.withColumn("rep", F.col(node)), "distinct")
    found = materialize(connected_components(edges_of(distinct), "a", "b"), "components")
    roots = distinct.join(found, distinct[node] == found["node"], "left").select(node, "least", F.coalesce("component", "rep").alias("root"))
    named = roots.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    return fps.join(materialize(roots.select(node, "root").join(named, "root"), "roots"), node)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id: smallest identifier that links within ``radius`` bits reach."""
    fps = materialize(fingerprints(docs, text, doc_id, words, seed), "fingerprints")
    edges = lambda distinct: links(distinct, [[m] for m in bucket_keys(bands_for(distinct.count(), radius), radius)], radius)
    return _components(fps, "fp0", edges).select("doc_id", F.col("fp0").alias("fp"), "component_id")


def sets_of(keys: DataFrame, distinct: DataFrame, rows: DataFrame, words: int, seed: int) -> DataFrame:
    """(key, shingles) of the ``keys``, made again from one row of each."""
    ids = materialize(distinct.join(keys, "key", "left_semi").select(F.col("least.doc_id").alias("i"), F.col("least.row").alias("r")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = rows.join(F.broadcast(ids) if few else ids, rows["doc_id"].eqNullSafe(ids["i"]) & (F.col("row") == F.col("r")), "left_semi")
    return materialize(shingle_sets(wanted, words, seed).join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """The ``pairs`` (a, b: keys of shingle sets) whose sets' Jaccard similarity is at least ``similarity``."""
    keys = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    sets = sets_of(keys, distinct, rows, words, seed)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("common") / (F.col("n") - F.col("common")) >= similarity).select("a", "b")


def set_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Spanning links (a, b) of the ``members`` (cluster, key, part, n, fp0.., shingles) of a cluster and of different parts.

    All pairs within the radius are compared on their sets, in the tasks that find them, unless links found there already
    join them. A cluster goes to pairs of its chunks: as many as spread it over the partitions, or as bound a chunk's rows and shingles.
    """
    fps = [c for c in members.columns if c.startswith("fp")]
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, shingles, spread = F.count(F.lit(1)), F.sum("n"), math.ceil(math.sqrt(2 * partitions))
    chunks = F.greatest(F.ceil(rows / CHUNK), F.ceil(shingles / CHUNK_SHINGLES), F.least(F.ceil(rows / SMALL_CHUNK), F.lit(spread)))
    sizes = materialize(members.groupBy("cluster").agg(rows.alias("rows"), shingles.alias("shingles"), chunks.cast("int").alias("chunks")), "clusters")
    known, dealt_rows, dealt_shingles = sizes.agg(F.count(F.lit(1)), F.sum(F.col("rows") * F.col("chunks")), F.sum(F.col("shingles") * F.col("chunks"))).first()
    groups = max(4 * partitions, -(-(dealt_rows or 0) // GROUP_ROWS), -(-(dealt_shingles or 0) // GROUP_SHINGLES))
    sizes = sizes.select("cluster", "chunks")
    dealt = members.join(F.broadcast(sizes) if known <= BROADCAST_IDS else sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64(F.col("cluster"), F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    dealt = dealt.select(*fps, "key", "n", "part", "own", "shingles", F.explode(pairs).alias("bucket")).withColumn("deal", F.pmod("bucket", F.lit(groups)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        key, n, part, own, bucket = (table.column(c).to_numpy() for c in ("key", "n", "part", "own", "bucket"))
        fp = np.stack([table.column(c).to_numpy() for c in fps], 1).view(np.uint64)
        lists = table.column("shingles").combine_chunks()
        held = SetIndex(lists.flatten().to_numpy(), lists.value_lengths().to_numpy())
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        two = np.repeat(np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts), np.diff(np.r_[starts, len(bucket)]))
        near = [np.zeros((2, 0), np.int64)]
        for i, j in pairs_sorted(fp, bucket, radius):
            fits = _sizes_allow(n, i, j, similarity) & (part[i] != part[j]) & ((own[i] != own[j]) | ~two[i])
            near.append(np.stack([i[fits], j[fits]]))
        i, j = np.concatenate(near, 1)
        forest = _Forest(len(key))
        same = np.argsort(part, kind="stable")
        again = part[same[1:]] == part[same[:-1]]
        forest.unite(same[1:][again], same[:-1][again])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        out = [np.zeros((2, 0), np.int64)]
        for first, last in zip(*_stretches(i), strict=True):
            row, others = i[first], j[first:last]
            others = others[forest.root[others] != forest.root[row]]
            if len(others):
                common = held.common(row)[others]
                others = others[common / (n[row] + n[others] - common) >= similarity]
                forest.unite(np.full(len(others), row), others)
                out.append(np.stack([key[np.full(len(others), row)], key[others]]))
        a, b = np.concatenate(out, 1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("deal").applyInArrow(compare, "a long, b long").distinct()


def _stretches(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    """Begin and end of each stretch of equal values."""
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)]
    return starts.tolist(), np.r_[starts[1:], len(sorted_values)].tolist() if len(starts) else []


class SetIndex:
    """The rows that hold each shingle of some sets, given one after another."""

    def __init__(self, shingles: np.ndarray, sizes: np.ndarray):
        self.rows = len(sizes)
        _, ids, holders = np.unique(shingles, return_inverse=True, return_counts=True)
        shared = holders[ids] > 1  # the others are in one set alone
        self.ids, owner = ids[shared], np.repeat(np.arange(self.rows), sizes)[shared]
        self.ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=self.rows))]
        self.holders = owner[np.argsort(self.ids, kind="stable")]
        self.begins = np.r_[0, np.cumsum(np.bincount(self.ids, minlength=len(holders)))]

    def common(self, row: int) -> np.ndarray:
        """How many shingles each set shares with that of ``row``."""
        ids = self.ids[self.ends[row] : self.ends[row + 1]]
        begin, size = self.begins[ids], self.begins[ids + 1] - self.begins[ids]
        places = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.holders[places], minlength=self.rows)


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, row (hash of the text), root, component_id: smallest identifier that links of ``similarity`` or more reach.

    The radius of candidates is what a pair of just that similarity has on average and three standard deviations.
    """
    fps = materialize(set_fingerprints(docs, text, doc_id, words, seed, WIDE), "fingerprints")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_hash(text).alias("row"), F.col(f"`{text}`").alias("text"))
    p, n = differing(similarity), BITS * WIDE
    radius = int(n * p + 3 * math.sqrt(n * p * (1 - p)))

    def edges_of(distinct: DataFrame) -> DataFrame:
        masks = tables_for(distinct.count(), similarity)
        near = materialize(links(distinct, masks[:FIRST_TABLES], radius // 2, _candidates(similarity), ("n",), across=False), "near")
        near = materialize(verified(near, distinct, rows, words, similarity, seed), "near-links")
        parts = materialize(connected_components(near, "a", "b"), "parts")
        by_part = distinct.drop("least").join(parts, distinct["key"] == parts["node"], "left").withColumn("part", F.coalesce("component", "key")).drop("node", "component")
        by_part = materialize(by_part, "by-part")
        rest = materialize(links(by_part, masks, radius, _candidates(similarity), ("n", "part")), "rest")
        if not rest.limit(1).count():
            return near
        clusters = materialize(connected_components(rest, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("cluster")), "clustered")
        members = by_part.join(clusters, "key").join(sets_of(clusters.select("key"), distinct, rows, words, seed), "key")
        return near.unionByName(set_links(members, radius, similarity))

    return _components(fps, "key", edges_of).select("doc_id", "row", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of similar documents: that of the smallest identifier, rows without one last.

    Of rows of one identifier, that of the smallest text hash stays; of repeated rows, one.
    """
    found = materialize(similar_documents(docs, text, doc_id, **options), "similar")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = found.groupBy("root").agg(F.min(row).alias("kept"))
    gone = found.join(kept, "root").where(row != F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).distinct()
    out = _without(docs, materialize(gone, "gone"), text, doc_id)
    repeated = materialize(found.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_same_id"), F.col("row").alias("_same_row")), "repeated")
    if not repeated.limit(1).count():
        return out
    twice = _only(out, repeated, text, doc_id)
    once = twice.withColumn("_r", row_hash(text)).dropDuplicates([doc_id, "_r"]).drop("_r")
    return _without(out, repeated, text, doc_id).unionByName(once)


def _without(docs: DataFrame, rows: DataFrame, text: str, doc_id: str, how: str = "left_anti") -> DataFrame:
    """``docs`` without (or of) the ``rows`` (identifier, row hash)."""
    i, r = rows.columns
    return docs.join(rows, docs[doc_id].cast("long").eqNullSafe(rows[i]) & (row_hash(text) == rows[r]), how)


def _only(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    return _without(docs, rows, text, doc_id, "left_semi")
