"""Line dedup: lines that several documents share stay in the first of them only.

Method. Lines are hashed to 128 bits and dealt to shards by hash. A shard builds a minimal
perfect hash straight over its line hashes, repeats and all; it indexes compact arrays: a 32-bit fingerprint, a
count (one, or two for two and more documents) and the first document. These arrays are a table, a row a
shard (:func:`line_index`). Documents then probe them: blocks of documents send the hashes of
their lines, with their places in the block, to the shards, and the places that
the arrays decide to drop come back. Nothing is joined by line. A very common line costs a shard
one row a block, not one a document.

Every line that probes is in the index, so its number is its own. A line that is not in it
would pass the fingerprint with chance 2**-32. Two different lines of one 128-bit hash: a chance of 1e-15 among
10**12 distinct lines.

Defined cases: null or empty text is one empty line. Rows with the same
identifier are one document. All rows without identifier are one document that comes last.
Neither gathers in one block: rows are dealt to blocks by identifier and text.
An empty table gives an empty table. Input columns named like the result columns
are replaced by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import NULL_ID, SPACE, without
from strandlake.llm.perfect_hash import MinimalPerfectHash
from strandlake.session import n_blocks, ship, text_size

#: Line rows that a shard should hold.
SHARD_ROWS = 200_000


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 16-byte key for each line; None for those too short to count."""
    digest = xxhash.xxh3_128_digest
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(SPACE)
        out.append(digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None)
    return out


class LineIndex:
    """Arrays under a minimal perfect hash of line hashes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, first: np.ndarray, last: np.ndarray):
        """Rows may repeat a line; ``first`` and ``last`` are the least and greatest document of each row."""
        self.hash = MinimalPerfectHash(h1, h2)
        slot = self.hash.lookup(h1, h2)
        self.fingerprint = np.zeros(self.hash.n, np.uint32)
        self.fingerprint[slot] = h2.astype(np.uint32)
        self.first = np.full(self.hash.n, NULL_ID, np.int64)
        np.minimum.at(self.first, slot, first)
        greatest = np.full(self.hash.n, -(1 << 63), np.int64)
        np.maximum.at(greatest, slot, last)
        self.count = np.where(self.first < greatest, 2, 1).astype(np.uint8)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 where unknown) and first document of each line."""
        count, first = np.zeros(len(h1), np.uint8), np.zeros(len(h1), np.int64)
        slot = self.hash.lookup(h1, h2)
        known = np.flatnonzero(slot >= 0)
        known = known[self.fingerprint[slot[known]] == h2[known].astype(np.uint32)]
        count[known], first[known] = self.count[slot[known]], self.first[slot[known]]
        return count, first

    def to_arrow(self, shard: int) -> pa.Table:
        arrays = [self.hash.to_bytes(), self.fingerprint.tobytes(), self.count.tobytes(), self.first.tobytes()]
        return pa.table([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in arrays)], names=INDEX_COLUMNS)

    @classmethod
    def from_arrow(cls, row: pa.Table) -> LineIndex:
        out = cls.__new__(cls)
        bits, *arrays = (row.column(c)[0].as_py() for c in INDEX_COLUMNS[1:])
        out.hash = MinimalPerfectHash.from_bytes(bits)
        out.fingerprint, out.count, out.first = (np.frombuffer(x, t) for x, t in zip(arrays, (np.uint32, np.uint8, np.int64), strict=True))
        return out


INDEX_COLUMNS = ["shard", "bits", "fingerprints", "counts", "firsts"]


def hashed_lines(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, places of the lines that count among all, h1, h2 of those)."""
    keys = [line_keys(t, min_chars) for t in texts]
    flat = [k for ks in keys for k in ks]
    places = np.fromiter((i for i, k in enumerate(flat) if k is not None), np.int64)
    pairs = np.frombuffer(b"".join([k for k in flat if k is not None]), np.uint64).reshape(-1, 2)
    return np.fromiter(map(len, keys), np.int64, len(keys)), places, pairs[:, 0].copy(), pairs[:, 1].copy()


def numbered(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts in it of the distinct pairs, number of each pair): the same whatever the order of the rows."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def line_index(found: DataFrame) -> DataFrame:
    """A row a shard: the arrays of :class:`LineIndex` as binary columns, from rows shard, h1, h2, first, last."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2, first, last = (table.column(c).to_numpy() for c in ("h1", "h2", "first", "last"))
        return LineIndex(h1.view(np.uint64), h2.view(np.uint64), first, last).to_arrow(table.column("shard")[0].as_py())

    return found.groupBy("shard").applyInArrow(build, "shard int, bits binary, fingerprints binary, counts binary, firsts binary")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``text`` replaced by the lines that stay, and the numbers of lines and of those dropped (long)."""
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, n_lines, n_dropped)
    rows, size = text_size(docs, text)
    blocks = n_blocks(docs, size)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows + size // 100) // SHARD_ROWS))
    names, text_at, id_at = docs.columns, docs.columns.index(text), docs.columns.index(doc_id)
    # Columns are renamed by position inside, so that no input name clashes with a working one.
    deal = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(blocks)).cast("int")
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], deal.alias("block"))

    def parts(table: pa.Table) -> tuple:
        ids = np.array([NULL_ID if x is None else x for x in table.column(f"c{id_at}").to_pylist()], np.int64)
        sizes, places, h1, h2 = hashed_lines(table.column(f"c{text_at}").to_pylist(), min_chars)
        return ids, sizes, places, h1, h2

    def lines(table: pa.Table) -> pa.Table:
        ids, sizes, places, h1, h2 = parts(table)
        order, starts, _ = numbered(h1, h2)
        owner = np.repeat(ids, sizes)[places][order]
        first, last = (np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)) if len(starts) else (owner, owner)
        h1, h2 = h1[order][starts], h2[order][starts]
        block = np.full(len(h1), table.column("block")[0].as_py(), np.int32)
        return pa.table([pa.array((h1 % np.uint64(shards)).astype(np.int32)), pa.array(block), pa.array(np.arange(len(h1), dtype=np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(first), pa.array(last)], names=["shard", "block", "place", "h1", "h2", "first", "last"])

    def probe(rows: pa.Table, index: pa.Table) -> pa.Table:
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        count, first = LineIndex.from_arrow(index).probe(h1, h2)
        hit = np.flatnonzero(count > 1)
        return pa.table([rows.column("block").take(hit), rows.column("place").take(hit), pa.array(first[hit])], names=["block", "place", "first"])

    schema = T.StructType([*base.drop("block").schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def keep(table: pa.Table, hits: pa.Table) -> pa.Table:
        ids, sizes, places, h1, h2 = parts(table)
        _, starts, number = numbered(h1, h2)
        shared, first = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
        if hits.num_rows:
            at = hits.column("place").to_numpy()
            shared[at], first[at] = True, hits.column("first").to_numpy()
        gone = np.zeros(int(sizes.sum()), bool)
        gone[places] = shared[number] & (first[number] != np.repeat(ids, sizes)[places])
        ends = np.cumsum(sizes)
        texts, dropped = [], []
        for value, a, b in zip(table.column(f"c{text_at}").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            drop = gone[a:b]
            dropped.append(int(drop.sum()))
            value = value or ""
            texts.append("\n".join([x for x, out in zip(value.split("\n"), drop.tolist(), strict=True) if not out]) if dropped[-1] else value)
        columns = [table.column(f"c{i}") for i in range(len(names))]
        columns[text_at] = pa.array(texts, pa.string())
        return pa.table([*columns, pa.array(sizes), pa.array(dropped, pa.int64())], names=schema.names)

    # The same shuffle of the documents serves both uses, as does that of the lines.
    found = base.groupBy("block").applyInArrow(lines, "shard int, block int, place int, h1 long, h2 long, first long, last long")
    hits = found.groupBy("shard").cogroup(line_index(found).groupBy("shard")).applyInArrow(probe, "block int, place int, first long")
    out = base.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(keep, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped))
