"""Target-distribution importance resampling of documents by hashed n-gram features.

Method: a DuckDB in each task. Its SQL unnests the words of whole texts, windows runs of one to three of
them, hashes each run by registered zlib CRC functions, and counts the buckets of each document. A word is hashed once, and the CRC of a run
follows from those of its words, as zlib's own combination has it, so that no run is built as text. These counts go to Parquet
in the shared folder; Spark merges them over documents and over the target, takes the gain of each bucket from the two
counts, sums gains over the counts of each document and adds Gumbel noise, so that the highest scores are a sample
without replacement in proportion to the importance.

A task holds about PIECE_CHARS characters in DuckDB at a time; longer texts come in pieces that begin with the last two words of the
piece before. The driver holds one gain a bucket, and one count a range of scores. Ranks come from ranges of (score, identifier)
that are sorted in their tasks and from the numbers of rows in the ranges before.

Defined cases: null text has no words, weight 0 and never a rank. Rows of one identifier are documents of their own; they
have the same noise. Rows without identifier take the noise of the empty identifier and come last among ties. An empty table gives
an empty table; an empty target makes the rarest features of the corpus the best.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import discard, materialize, ship

BUCKETS = 10_000
SEED = 42
PIECE_CHARS = 1 << 19
#: Limit of a task's DuckDB, which has no temporary folder.
MEMORY = "512MB"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FEATURES_SQL = r"""
WITH word AS (
  SELECT piece, doc, skip, unnest(x) AS w, unnest(range(len(x))) AS i
  FROM (SELECT piece, doc, skip, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS x FROM pieces)
),
hashed AS (SELECT piece, doc, i, i >= skip AS own, zlib_crc32(w) AS one, strlen(w) AS n FROM word),
near AS (SELECT doc, own, one, n, lag(one, 1) OVER v AS p, lag(n, 1) OVER v AS pn, lag(one, 2) OVER v AS q FROM hashed WINDOW v AS (PARTITION BY piece ORDER BY i)),
runs AS (SELECT doc, crc32_runs(one, n, p, pn, q) AS crcs FROM near WHERE own),
feature AS (SELECT doc, unnest(crcs) AS crc, unnest([1, 0, 0]) AS word FROM runs)
SELECT doc * $buckets + crc % $buckets AS key, count(*)::BIGINT AS n, sum(word)::BIGINT AS words FROM feature WHERE crc IS NOT NULL GROUP BY key
"""


def _crc32(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    view, crc = memoryview(data) if data is not None else b"", zlib.crc32
    return pa.array(np.fromiter((crc(view[a:b]) for a, b in zip(at, at[1:], strict=False)), np.uint32, len(column)))


def _zeros() -> list[np.ndarray]:
    """For 2**k zero bytes after what a CRC is of, k = 0, 1, ...: the new CRC by each byte of the old one, which adds up by XOR."""
    byte = np.arange(256, dtype=np.uint32)
    table = byte.copy()
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    values = byte[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    out = [table[values & 0xFF] ^ (values >> 8)]
    while len(out) < 32:
        out.append(_shift(out[-1], out[-1]))
    return out


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


_ZEROS = _zeros()


def _by_size() -> np.ndarray:
    """The same for 0 to 63 zero bytes, by their number."""
    byte = np.arange(256, dtype=np.uint32)
    rows = [byte[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])]
    while len(rows) < 64:
        rows.append(_shift(_ZEROS[0], rows[-1]))
    return np.stack(rows)


_BY_SIZE = _by_size().reshape(-1)


def append(before: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of bytes whose first part has the CRC ``before`` and whose rest, of ``size`` bytes, has ``crc``: what zlib gives for both in a row."""
    out, at = before.astype(np.uint32), (size & 63) << 10
    out = _BY_SIZE[at + (out & 0xFF)] ^ _BY_SIZE[at + 256 + (out >> 8 & 0xFF)] ^ _BY_SIZE[at + 512 + (out >> 16 & 0xFF)] ^ _BY_SIZE[at + 768 + (out >> 24)]
    for k in range(6, int(size.max(initial=0)).bit_length()):
        out = np.where(size >> k & 1, _shift(_ZEROS[k], out), out)
    return out ^ crc


def _runs(one: pa.Array, n: pa.Array, p: pa.Array, pn: pa.Array, q: pa.Array) -> pa.Array:
    """CRCs of a word, of it after a space and the word before, and of the two before; null where there are none."""
    known = np.stack([np.ones(len(one), bool), *(x.is_valid().to_numpy(zero_copy_only=False) for x in (p, q))], 1)
    one, n, p, pn, q = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (one, n, p, pn, q))
    space = np.full(len(one), zlib.crc32(b" "), np.uint32)
    rest = append(space, one, n)
    two = append(p, rest, n + 1)
    three = append(append(q, append(space, p, pn), pn + 1), rest, n + 1)
    values = pa.array(np.stack([one, two, three], 1).astype(np.uint32).reshape(-1), mask=~known.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(one) + 1, 3, dtype=np.int32)), values)


class FeatureCounter:
    """A DuckDB of one thread that counts the buckets of texts."""

    def __init__(self, buckets: int):
        import duckdb

        self.buckets = buckets
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.create_function("zlib_crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        self.db.create_function("crc32_runs", _runs, ["UINTEGER", "BIGINT", "UINTEGER", "BIGINT", "UINTEGER"], "UINTEGER[]", type="arrow", null_handling="special")

    def pieces(self, texts: list[str]) -> Iterator[pa.Table]:
        """Rows doc, piece, skip (words that the piece before has had), body; about PIECE_CHARS characters a table."""
        rows, held, piece = [], 0, 0
        for doc, text in enumerate(texts):
            begin, lead = 0, []
            while begin < len(text):
                stop = len(text)
                if stop - begin > PIECE_CHARS:
                    gap = _GAP.search(text, begin + PIECE_CHARS)
                    stop = gap.start() if gap else stop
                body = text[begin:stop] if begin or stop < len(text) else text
                rows.append((doc, piece, len(lead), " ".join([*lead, body]).replace("\0", " ")))
                if stop < len(text):
                    lead = (lead + _WORD.findall(body)[-2:])[-2:]
                begin, piece, held = stop, piece + 1, held + stop - begin
                if held >= PIECE_CHARS:
                    yield self._table(rows)
                    rows, held = [], 0
        if rows:
            yield self._table(rows)

    @staticmethod
    def _table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "piece", "skip", "body"])

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; ends of each text's part in what follows, from 0; buckets in order and their counts."""
        parts = [np.zeros((3, 0), np.int64)]
        for table in self.pieces(texts):
            self.db.register("pieces", table)
            found = self.db.sql(FEATURES_SQL, params={"buckets": self.buckets}).to_arrow_table()
            self.db.unregister("pieces")
            parts.append(np.stack([found.column(c).to_numpy() for c in ("key", "n", "words")]))
        rows = np.concatenate(parts, 1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        # Pieces of one text that fell into several tables bring a bucket several times.
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]][: rows.shape[1]])
        key, n, words = rows[0][first], *(np.add.reduceat(x, first) if len(first) else x for x in rows[1:])
        doc, bucket = key // self.buckets, (key % self.buckets).astype(np.int32)
        return np.bincount(doc, words, len(texts)).astype(np.int64), np.searchsorted(doc, np.arange(len(texts) + 1)), bucket, n.astype(np.int32)


_counters: dict[int, FeatureCounter] = {}


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns as c0, c1, ..., with n_words, and arrays of buckets and counts, of each document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*rows.schema.fields[1:], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("buckets", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.IntegerType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if buckets not in _counters:
            _counters[buckets] = FeatureCounter(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words, ends, *lists = _counters[buckets].count([x or "" for x in part.column(0).to_pylist()])
                arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(words), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def merged(counted: DataFrame, name: str) -> DataFrame:
    """bucket and the sum of its counts."""
    return counted.select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from tables of :func:`bucket_counts`: ``buckets`` numbers."""
    spark = corpus.sparkSession
    both = merged(corpus, "s").join(merged(target, "t"), "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0).collect()
    total_s, total_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = np.floor(1000 * np.log((r["t"] + 1) * (total_s + buckets) / ((r["s"] + 1) * (total_t + buckets))))
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an identifier, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, order: list[Column], eligible: Column) -> DataFrame:
    """``scored`` with a rank column: 1, 2, ... along ``order`` among the eligible, null for others. Written, so that ranges stand still."""
    spark = scored.sparkSession
    place = T.StructType([*scored.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(at, at + n))], names=place.names)
            at += n

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(scored.where(eligible).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, place), "ranges")
    sizes = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offset = {}, 0
    for k in sorted(sizes):
        before[k], offset = offset, offset + sizes[k]
    starts = spark.createDataFrame(list(before.items()), "range int, start long")
    numbered = placed.join(F.broadcast(starts), "range").select(*scored.columns, (F.col("start") + F.col("place") + 1).alias("rank"))
    return numbered.unionByName(scored.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of each document; ``percent`` of those with ``min_words`` are drawn."""
    spark = docs.sparkSession
    counted = materialize(bucket_counts(docs, buckets, text, (doc_id,)), "features")
    gain = F.from_json(F.lit(str(gains(counted, bucket_counts(target, buckets, text), buckets).tolist())), "array<bigint>")
    # Sums stay with the row that has the counts: nothing is exploded or shuffled.
    total = lambda each: F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    weight = total(F.zip_with("buckets", "counts", lambda b, n: F.get(gain, b) * n))
    weighed = counted.select(F.col("c0").alias("doc_id"), "n_words", total("counts").alias("n_features"), weight.alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    discard(counted)
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked(scored, order, able).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
