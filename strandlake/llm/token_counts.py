"""Token counts of whole texts without shuffling a pre-token.

Method: a map-side look-up in two tiers. A compact hash table, open addressing over arrays, holds the lengths in
tokens of frequent pre-tokens and goes to all workers by broadcast: at most TABLE_SLOTS slots of 17 bytes. Tasks cut texts into
pre-tokens in arrays, look all of them up at once, and ask a worker's own cache for the rest; what the cache does not know
goes to the vocabulary's merges, once a worker while it is remembered. Nothing is shuffled.

The table's pre-tokens come from a bounded sample (SAMPLE_TEXTS texts of at most SAMPLE_CHARS characters). It decides what
is fast, never a result: keys are compared in full, as up to 16 bytes and their number.

Cutting follows the byte-level pattern: contractions, a space with letters, numbers or signs, white space. What counts as
letter, number and white space is asked of the vocabulary's own pre-tokeniser, once for each character that
occurs. Added tokens inside texts are found first, as the library finds them. Vocabularies that are prepared otherwise, and
.model files, are encoded whole by their library.

Defined cases: null text is empty and has no tokens. Repeated rows count each on their own. Long texts are worked through in
pieces that end where white space begins, where the pattern starts anew. An empty table gives an empty table. Columns named like the
result's are replaced by them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import without
from strandlake.llm.packing import _BYTE_LETTERS, resolve_vocabulary
from strandlake.session import ship

#: Slots of the broadcast table; at most half of them are used.
TABLE_SLOTS = 1 << 16
SAMPLE_TEXTS, SAMPLE_CHARS = 2000, 10_000
#: Pre-tokens whose length a worker remembers in each of two generations.
CACHE_WORDS = 200_000
#: Code points that are worked on at once.
PIECE = 1 << 20
RESULT = ["n_bytes", "n_tokens", "over_limit"]
#: How a vocabulary file describes the preparation that :class:`Cutter` follows.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_SPACE, _LETTER, _NUMBER, _SIGN, _END, _UNKNOWN = range(6)
_BREAK = re.compile(r"(?<=[A-Za-z0-9.,;:!?)])[ \n]")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Cutter:
    """Pre-tokens of texts in arrays."""

    def __init__(self, tokenizer):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)

    def _ask(self, points: np.ndarray) -> None:
        """Class of characters: they join what they belong to."""
        for p in points.tolist():
            kinds = ((_LETTER, "a"), (_NUMBER, "1"), (_SIGN, "!"))
            self.classes[p] = next((k for k, before in kinds if len(self.split(before + chr(p))) == 1), _SPACE)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(text's number, first byte, bytes) of each pre-token, and the bytes of all texts with one between any two."""
        joined = "\0".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = joined.encode("utf-8")
        kind = self.classes[points]
        if (kind == _UNKNOWN).any():
            self._ask(np.unique(points[kind == _UNKNOWN]))
            kind = self.classes[points]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)[:-1] - 1
        kind[ends] = _END
        n = len(points)
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (data,)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        # White space before anything but an end: its last character is apart, and joins what follows if it is a space.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
        start[last] = True
        start[last + 1] = points[last] != 32
        self._contractions(points, kind, start)
        at = np.flatnonzero(start)
        at = at[kind[at] != _END]
        stops = np.zeros(n + 1, bool)
        stops[:n] = start | (kind == _END)
        stops[n] = True
        stop = np.flatnonzero(stops)
        after = stop[np.searchsorted(stop, at, "right")]
        if len(data) == n:
            first, size = at, after - at
        else:
            width = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), out=width[1:])
            first, size = width[at], width[after] - width[at]
        return np.searchsorted(ends, at, "right"), first, size, data

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        p = np.flatnonzero(points == 39)
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        before = np.where(p > 0, points[p - 1], 0)
        signs = np.where(p > 0, kind[p - 1] == _SIGN, False)
        p = p[(before != 32) & ~signs]
        one, two = padded[p + 1], padded[p + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.logical_or.reduce([(one == a) & (two == b) for a, b in (b"re", b"ve", b"ll")])
        for size, hits in ((2, p[short]), (3, p[long & ~short])):
            start[hits + 1] = False
            after = hits + size
            start[after[after < len(start)]] = True


def keys_of(data: bytes, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pre-tokens of at most 16 as two little-endian numbers, padded with zeros."""
    padded = data + bytes(16)
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    shift = lambda k: (_FULL >> ((8 - np.clip(k, 1, 8)) * 8).astype(np.uint64)) * (k > 0)
    return words[first] & shift(size), words[np.minimum(first + 8, len(words) - 1)] & shift(size - 8)


class LengthTable:
    """Open addressing over arrays: two words and the number of bytes, to the number of tokens (0: free)."""

    def __init__(self, slots: int = TABLE_SLOTS):
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.tokens = np.zeros(slots, np.uint8), np.zeros(slots, np.uint16)
        self.reach = 0

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(40)).astype(np.int64) & (len(self.low) - 1)

    def fill(self, words: list[bytes], tokens: list[int]) -> None:
        data = b"".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low, high = keys_of(data, np.cumsum(size) - size, size)
        for k, at in enumerate(self._slot(low, high, size).tolist()):
            far = 0
            while self.tokens[(at + far) & (len(self.low) - 1)]:
                far += 1
            at = (at + far) & (len(self.low) - 1)
            self.low[at], self.high[at], self.size[at], self.tokens[at] = low[k], high[k], size[k], tokens[k]
            self.reach = max(self.reach, far + 1)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each, 0 where not held."""
        out = np.zeros(len(low), np.int64)
        left, at = np.arange(len(low)), self._slot(low, high, size)
        for _ in range(self.reach):
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.size[at] == size[left])
            out[left] = np.where(same, self.tokens[at], 0)
            more = ~same & (self.tokens[at] > 0)
            if not more.any():
                break
            left, at = left[more], (at[more] + 1) & (len(self.low) - 1)
        return out


class TokenCounter:
    """Numbers of tokens of whole texts, by the two tiers or else by the library."""

    def __init__(self, path: str, table: LengthTable | None = None):
        self.table, self.known, self.older, self.special = table, {}, {}, []
        self.cutter = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        described = json.loads(Path(path).read_text("utf-8"))
        added, model = described["added_tokens"], described["model"]
        plain = all(not x[k] for x in added for k in ("single_word", "lstrip", "rstrip"))
        if described["normalizer"] is None and described["pre_tokenizer"] == _PRE_TOKENIZER and model["type"] == "BPE" and not model.get("dropout") and len(added) <= 1 and plain:
            self.cutter, self.merge, self.special = Cutter(tokenizer), tokenizer.model.tokenize, [x["content"] for x in added]

    def lengths(self, words: list[bytes]) -> list[int]:
        """Tokens of pre-tokens, by the worker's cache or the merges."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        out = []
        for w in words:
            n = self.known.get(w) or self.older.get(w) or len(self.merge(w.decode("latin-1").translate(_BYTE_LETTERS)))
            if len(w) <= 200:
                self.known[w] = n
            out.append(n)
        return out

    def pieces(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Texts and parts of long ones, with their numbers, about PIECE characters at a time."""
        at, parts, held = [], [], 0
        for i, text in enumerate(texts):
            begin = 0
            while begin < len(text):
                stop = len(text)
                if stop - begin > PIECE:
                    found = _BREAK.search(text, begin + PIECE)
                    stop = found.start() if found else stop
                at.append(i)
                parts.append(text[begin:stop] if begin or stop < len(text) else text)
                held += stop - begin
                begin = stop
                if held >= PIECE:
                    yield at, parts
                    at, parts, held = [], [], 0
        if parts:
            yield at, parts

    def count(self, texts: list[str]) -> np.ndarray:
        if self.cutter is None:
            return np.array(self.whole(texts), np.int64)
        out = np.zeros(len(texts), np.int64)
        owners = list(range(len(texts)))
        for special in self.special:
            if any(special in t for t in texts):
                split = [t.split(special) for t in texts]
                out += np.array([len(x) - 1 for x in split], np.int64)
                owners = [i for i, x in enumerate(split) for _ in x]
                texts = [x for parts in split for x in parts]
        owners = np.array(owners, np.int64)
        for at, parts in self.pieces(texts):
            number, first, size, data = self.cutter.cut(parts)
            out += np.bincount(owners[np.array(at)][number], weights=self._tokens(data, first, size), minlength=len(out)).astype(np.int64)
        return out

    def _tokens(self, data: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        tokens = np.zeros(len(first), np.int64)
        short = np.flatnonzero(size <= 16)
        low, high = keys_of(data, first[short], size[short])
        if self.table is not None:
            tokens[short] = self.table.find(low, high, size[short])
        miss = short[tokens[short] == 0]
        if len(miss):
            held = tokens[short] == 0
            # One number a miss, by sorting on the whole key.
            rows = np.rec.fromarrays([low[held], high[held], size[miss]])
            _, where, which = np.unique(rows, return_index=True, return_inverse=True)
            one = miss[where]
            words = [data[a : a + k] for a, k in zip(first[one].tolist(), size[one].tolist(), strict=True)]
            tokens[miss] = np.array(self.lengths(words), np.int64)[which]
        for i in np.flatnonzero(size > 16).tolist():
            tokens[i] = self.lengths([data[first[i] : first[i] + size[i]]])[0]
        return tokens


def frequent(docs: DataFrame, path: str, text: str = "text") -> LengthTable | None:
    """The table of the most frequent short pre-tokens in a bounded sample; None for vocabularies that are encoded whole."""
    counter = TokenCounter(path)
    if counter.cutter is None:
        return None
    c = F.col(f"`{text}`")
    spread = docs.where(c.isNotNull() & (F.length(c) <= SAMPLE_CHARS) & (F.pmod(F.xxhash64(c), F.lit(4)) == 0))
    texts = [r[0] for r in spread.select(c).limit(SAMPLE_TEXTS).collect()]
    seen: Counter = Counter()
    for _, parts in counter.pieces(texts):
        _, first, size, data = counter.cutter.cut(parts)
        seen.update(data[a : a + k] for a, k in zip(first.tolist(), size.tolist(), strict=True) if k <= 16)
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: TABLE_SLOTS // 2]]
    table = LengthTable()
    table.fill(words, counter.lengths(words))
    return table


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (boolean) in place of columns of these names."""
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, *(c for c in RESULT if c != text.lower()))
    table = spark.sparkContext.broadcast(frequent(docs, resolve_vocabulary(vocabulary), text))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    at, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = TokenCounter(resolve_vocabulary(vocabulary))
        counter = _counters[vocabulary]
        counter.table = table.value
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            n = counter.count(texts)
            size = pa.array([len(t.encode("utf-8")) if not t.isascii() else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(n, pa.int64()), pa.array(n > limit)], names=names)

    return docs.mapInArrow(run, schema)
