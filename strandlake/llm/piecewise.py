"""Document fingerprints by context-triggered piecewise hashing.

Method. A rolling hash of the last seven bytes ends a chunk wherever it meets a
condition set by the block size, so an edit moves only the boundaries near it. Each
chunk gives one character; a fingerprint is ``size:signature:signature at twice
the size``. Fingerprints are compared at equal or doubled block sizes, by edit
distance (insertions and deletions) of their signatures, in bit-parallel form over
many pairs at once. Signatures that share no run of characters count as unlike.

Defined cases: null counts as empty; the empty text has the fingerprint ``3::``.
Equal texts have equal fingerprints and likeness 1. A null identifier sorts first.
Rows with the same identifier follow each other in text order. The only document of
a table is its own next one. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize, ship, text_size

WINDOW = 7
LENGTH = 64
SMALLEST = 3
#: Bytes of a text that are hashed at a time, and of a range of documents that one task sorts and streams.
PIECE = 1 << 16
RANGE_BYTES = 256 << 20
#: Characters of a text that range partitioning samples, for rows that share an identifier.
HEAD = 64
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WRAP = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of the base modulo 2**64."""
    out, done, by = np.ones(n, np.uint64), 1, base
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(by)
        by = by * by & _WRAP
        done *= 2
    return out


_UP, _DOWN = _powers(_STEP, PIECE + WINDOW + 1), _powers(_BACK, PIECE + WINDOW + 1)


def fingerprint(data: bytes) -> str:
    """Texts are hashed in pieces of fixed length, so memory does not grow with them.

    With S(x) the sum of (byte + 1) step**-i over the bytes before x, the hash of bytes a to b is
    (S(b) - S(a)) step**b, for the rolling window and for chunks alike. For every block size only the
    first boundaries, S and step**x there, and their number are kept.
    """
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    top = 0
    while (SMALLEST << top) * LENGTH < n:
        top += 1
    kept: list[list[np.ndarray]] = [[] for _ in range(top + 2)]
    held, counts = [0] * (top + 2), [0] * (top + 2)
    sum_lo, lo = 0, 0
    for at in range(0, n, PIECE):
        back = at - max(0, at - WINDOW + 1)
        # S at the piece's first byte, looking back one window.
        if at:
            sum_lo = (sum_lo + int(sums[at - back - lo]) * pow(_BACK, lo, 1 << 64)) & _WRAP  # noqa: F821
        lo = at - back
        block = np.frombuffer(data, np.uint8, min(at + PIECE, n) - lo, lo).astype(np.uint64) + np.uint64(1)
        m = len(block)
        sums = np.empty(m + 1, np.uint64)
        sums[0] = 0
        np.cumsum(block * _DOWN[:m], out=sums[1:])
        rolling = sums[1:].copy()
        if m > WINDOW:
            rolling[WINDOW:] -= sums[1 : m + 1 - WINDOW]
        rolling *= _UP[:m]
        rolling *= _MIX
        context = (rolling >> np.uint64(34)).astype(np.uint32)
        ends = np.flatnonzero(context[back:] % np.uint32(SMALLEST) == SMALLEST - 1) + back
        up_lo, down_lo = np.uint64(pow(_STEP, lo, 1 << 64)), np.uint64(pow(_BACK, lo, 1 << 64))
        for k in range(top + 2):
            if k:
                size = SMALLEST << k
                ends = ends[context[ends] % np.uint32(size) == size - 1]
            if not len(ends):
                break
            counts[k] += len(ends)
            if held[k] < LENGTH - 1:
                first = ends[: LENGTH - 1 - held[k]] + 1
                held[k] += len(first)
                kept[k].append(np.stack([(first + lo).astype(np.uint64), sums[first] * down_lo + np.uint64(sum_lo), _UP[first] * up_lo]))
    total = (sum_lo + int(sums[m]) * pow(_BACK, lo, 1 << 64)) & _WRAP
    last = np.array([[n], [total], [pow(_STEP, n, 1 << 64)]], np.uint64)
    level = top
    while level and counts[level] < LENGTH // 2:
        level -= 1
    return f"{SMALLEST << level}:{_signature(kept[level], last)}:{_signature(kept[level + 1], last)}"


def _signature(kept: list[np.ndarray], last: np.ndarray) -> str:
    """A character a chunk; what follows the last boundary that counts is one chunk."""
    to = np.concatenate([*kept, last], 1)
    if to.shape[1] > 1 and to[0, -2] == to[0, -1]:
        to = to[:, :-1]
    since = np.concatenate([[np.uint64(0)], to[1, :-1]])
    h = (to[1] - since) * to[2] * _MIX
    return _ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def _collapse(s: str) -> str:
    """Runs of one character beyond three say nothing more."""
    out, run = [], 0
    for i, c in enumerate(s):
        run = run + 1 if i and c == s[i - 1] else 1
        if run <= 3:
            out.append(c)
    return "".join(out)


def _has_run(s: str) -> bool:
    return any(c * 4 in s for c in set(s)) if len(set(s)) < len(s) else False


def _related(a: str, b: str) -> bool:
    k = min(WINDOW, max(1, min(len(a), len(b)) // 2))
    return any(a[i : i + k] in b for i in range(len(a) - k + 1))


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences, pair by pair, of strings of at most 64 characters."""
    n = len(a)
    left, right = (np.frombuffer(b"".join(x.encode().ljust(LENGTH, pad) for x in side), np.uint8).reshape(n, LENGTH) for side, pad in ((a, b"\0"), (b, b"\1")))
    v = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(max(map(len, b), default=0)):
        match = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & match
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(a))
    where, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        pairs = [(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if p == 2 * q else [(p2, q1)] if q == 2 * p else []
        for s, t in pairs:
            s, t = (_collapse(z) if _has_run(z) else z for z in (s, t))
            if s and t and _related(s, t):
                where.append(i)
                left.append(s)
                right.append(t)
    if where:
        lengths = np.array([len(s) + len(t) for s, t in zip(left, right, strict=True)])
        np.maximum.at(out, where, 2 * common_subsequence(left, right) / lengths)
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _judge(doc_ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The result columns, of texts and of those that follow them."""
    encode = lambda t: t.encode("utf-8", "surrogatepass")
    data = [encode(t) for t in texts]
    prints = [fingerprint(d) for d in data]
    changed = [encode(edited(t, f)) for t, f in zip(texts, following, strict=True)]
    new_prints = [p if c == d else fingerprint(c) for c, d, p in zip(changed, data, prints, strict=True)]
    # Most texts follow the one before them here.
    next_prints = [prints[i + 1] if i + 1 < len(texts) and f is texts[i + 1] else fingerprint(encode(f)) for i, f in enumerate(following)]
    return [
        pa.array(doc_ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
        pa.array(prints, pa.string()), pa.array(new_prints, pa.string()), pa.array(likeness(prints, new_prints), pa.float64()), pa.array(likeness(prints, next_prints), pa.float64()),
    ]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted range, row by row as it streams; its first text and its last row go on as they are."""
    part, waiting, started = None, None, False
    text_type = [pa.string(), pa.bool_(), pa.int32()]

    def edge(doc_id, text, first):
        columns = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([v], t) for v, t in zip((text, first, part), text_type, strict=True))], names=[*_NAMES, "text", "first", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(batch.column(0).to_pylist(), ((t or "") for t in batch.column(1).to_pylist()), strict=True))
        if not started:
            part, started = batch.column(2)[0].as_py(), True
            yield edge(None, rows[0][1], True)
        rows = [waiting, *rows] if waiting else rows
        waiting = rows.pop()
        if rows:
            texts = [t for _, t in rows]
            found = _judge([d for d, _ in rows], texts, [*texts[1:], waiting[1]])
            n = len(rows)
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(n, t) for t in text_type)], names=[*_NAMES, "text", "first", "part"])
    if waiting:
        yield edge(*waiting, False)


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; other columns are left out.

    The next document is the one with the next identifier, and after the last the first. Spark deals the
    documents to ranges of identifiers (and of the texts' heads, so rows of one identifier may fill many), sorts
    each and streams it. Only the first text and the last row of a range are left over: a table of two
    rows a range, whose numbers alone are put in order to join each last row with the text that follows it.
    """
    spark = docs.sparkSession
    ship(spark)
    _, size = text_size(docs, text)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, HEAD)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_stream, f"{_RESULT}, text string, first boolean, part int")
    found = materialize(found, "ranges")
    firsts = found.where("first").select(F.col("part").alias("next"), F.col("text").alias("following"))
    order = found.where("first").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))  # numbers of ranges
    lasts = found.where("not first").select("doc_id", "text", "part").join(order, "part").join(firsts, "next").select("doc_id", "text", "following")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_judge(*(batch.column(i).to_pylist() for i in range(3))), names=_NAMES)

    return found.where("part is null").select(*_NAMES).unionByName(lasts.mapInArrow(run, _RESULT))
