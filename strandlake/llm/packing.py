"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: minimum bin slack. For each bin, a bitset subset-sum over the lengths still
available finds the fullest combination that holds the longest piece left; it is
removed, as many times as the counts allow. Packing works on counts of lengths
only: at most ``capacity`` of them whatever the corpus, so the plan is made on the
driver in bounded memory. Pieces then find their place by their rank among
pieces of the same length. Ranks come from counts by (task, length), so no length
gathers its pieces in one task.

Defined cases: null or empty text is a document of the end id alone. Repeated rows
are packed each on their own. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import materialize, ship

#: Words whose ids a worker remembers in each of two generations.
CACHE_WORDS = 200_000
_END = bytes(4)
#: A digit that hardly any text holds: a pre-token of its own, it separates words that are encoded at once.
_SEPARATOR = "\u0660"
_SIGNS = string.punctuation.encode()
_MARKS = re.compile("[\u0300-\u036f]")
#: How a vocabulary file describes the preparation of texts that :class:`WordTokenizer` shortens.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Ids of whole texts from remembered ids of words.

    The vocabulary's pre-tokeniser never joins characters across white space, so
    the ids of a text are those of its white-space separated words in turn.
    Words that were not met for a generation are forgotten. Texts of vocabularies that
    are prepared in any other way are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(Path(path).read_text("utf-8"))
        self.by_word = described["normalizer"] == _NORMALIZER and described["pre_tokenizer"] == _PRE_TOKENIZER and described["model"]["type"] == "BPE"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self._ids(_SEPARATOR)
        self.merge = self.tokenizer.model.tokenize
        self.runs: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        known, mark = self.known, self.mark
        texts = [w.decode("utf-8") for w in words]
        plain = [i for i, t in enumerate(texts) if _SEPARATOR not in t and len(t) < 200]
        # The tokens of the separator follow each other nowhere else: UTF-8 bytes of one character are not part of others.
        ids = np.frombuffer(self._ids(f" {_SEPARATOR} ".join([texts[i] for i in plain] + [""])), np.uint32)
        wanted = np.frombuffer(mark, np.uint32)
        n = len(wanted)
        ends = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - n + 1 + k] == wanted[k] for k in range(n)])) if len(ids) >= n else np.zeros(0, np.int64)
        if len(ends) == len(plain):
            at = 0
            for i, end in zip(plain, ends.tolist(), strict=True):
                known[words[i]] = ids[at:end].tobytes()
                at = end + n
            rest = set(range(len(words))).difference(plain)
        else:
            rest = range(len(words))
        for i in rest:
            known[words[i]] = self._ids(texts[i])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word:
            return self._ids(text)
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        data = text.encode("utf-8")
        # A-Z may go to lower case at once, unless a mark would then compose otherwise or a special token appear.
        if b"<|" not in data and (text.isascii() or not _MARKS.search(text)):
            data = data.lower()
        words = data.split()
        get = self.known.get
        out: list = list(map(get, words))
        others: dict[bytes, list[int]] = {}
        at = -1
        while True:
            try:
                at = out.index(None, at + 1)
            except ValueError:
                break
            word = words[at]
            ids = get(word) or self._meet(word)
            if ids is None:
                others.setdefault(word, []).append(at)
                out[at] = b""
            else:
                out[at] = ids
        if others:
            self._learn(list(others))
            for word, places in others.items():
                for at in places:
                    out[at] = self.known[word]
        return b"".join(out)

    def _meet(self, word: bytes) -> bytes | None:
        """Ids of a word that is not known; None if it has to go through the whole pipeline."""
        known, older = self.known, self.older.get
        ids = older(word)
        if ids is None:
            # Letters and a run of ASCII signs after them are apart for the pre-tokeniser, and so are their ids.
            bare = word.rstrip(_SIGNS)
            stem = _letters(bare) if bare else b""
            if stem is None:
                return None
            ids = b""
            if stem:
                ids = known.get(stem) or older(stem)
                if ids is None:
                    # Letters that normalising leaves alone go straight to the merges.
                    letters = stem.decode("ascii") if stem.isascii() else stem.decode("latin-1").translate(_BYTE_LETTERS)
                    ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
                known[stem] = ids
            if len(bare) < len(word):
                run = word[len(bare) :]
                ids += self.runs.get(run) or self._run(run)
        known[word] = ids
        return ids

    def _run(self, run: bytes) -> bytes:
        if len(self.runs) > 10_000:
            self.runs.clear()
        ids = self.runs[run] = self._ids(run.decode("ascii"))
        return ids


def _letters(word: bytes) -> bytes | None:
    """The lower-cased word if it is letters only and in composed form, else None."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    text = word.decode("utf-8")
    if not text.isalpha() or "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
        return None
    return text.lower().encode("utf-8")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as the character of its number where that prints, else as one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def resolve_vocabulary(name: str) -> str:
    """A vocabulary file's path on this machine: a path as such, or a name of the public files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Minimum bin slack over a multiset of lengths: [(lengths in a bin, number of such bins)].

    Bits of an integer are the sums that can be reached. Lengths join from the
    longest down, and the search ends as soon as a full bin can be reached; going
    back over the stored bitsets gives the combination.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be within the capacity")
    mask = (1 << (capacity + 1)) - 1
    plan = []
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        reach, trail = 1 << longest, []
        full = 1 << capacity
        for size in lengths:
            if reach & full:
                break
            n = min(left[size] - (size == longest), (capacity - longest) // size)
            part = 1
            while n > 0:  # bounded multiplicity in binary parts
                take = min(part, n)
                before = reach
                reach |= (reach << (size * take)) & mask
                trail.append((size, take, before))
                n -= take
                part *= 2
                if reach & full:
                    break
        at = reach.bit_length() - 1
        used: dict[int, int] = {longest: 1}
        for size, take, before in reversed(trail):
            if not before >> at & 1:
                used[size] = used.get(size, 0) + take
                at -= size * take
        times = min(left[k] // n for k, n in used.items())
        plan.append((tuple(k for k, n in sorted(used.items(), reverse=True) for _ in range(n)), times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        if len(left) != len(lengths):
            lengths = [k for k in lengths if k in left]
    return plan


class Placement:
    """From (length, rank among equal lengths) to (sequence, offset)."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        start: dict[int, int] = {}
        rows = []
        base = 0
        for sizes, times in plan:
            offset = 0
            for size in sizes:
                rows.append((size, start.get(size, 0), base, offset))
                start[size] = start.get(size, 0) + times
                offset += size
            base += times
        rows.sort()
        self.size, self.start, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 4).T
        self.sequences = base

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Entries are sorted by (length, first rank).
        lo = np.searchsorted(self.size, size, "left")
        hi = np.searchsorted(self.size, size, "right")
        while True:  # bisection for all rows at once
            open_ = hi - lo > 1
            if not open_.any():
                break
            mid = (lo + hi) // 2
            right = open_ & (self.start[np.minimum(mid, len(self.start) - 1)] <= rank)
            lo = np.where(right, mid, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return self.base[lo] + rank - self.start[lo], self.offset[lo]


_PIECES = "piece int, start long, length long, ids_crc32 long, task int, local_rank long, ids binary"


def cut(docs: DataFrame, vocabulary: str, capacity: int, text: str, doc_id: str, keep_ids: bool) -> DataFrame:
    """One row a piece, with its rank among the task's pieces of that length."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, seen = tokenizer_at(resolve_vocabulary(vocabulary)), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, at, start, length, crc, rank, blob = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                tokens = tokenizer.encode(value or "") + _END
                for k in range(0, len(tokens), 4 * capacity):
                    piece = tokens[k : k + 4 * capacity]
                    n = len(piece) // 4
                    ids.append(i)
                    at.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    rank.append(seen.get(n, 0))
                    seen[n] = rank[-1] + 1
                    blob.append(piece if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(rank, pa.int64()), pa.array(blob, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank", "ids"],
            )

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(pieces, f"doc_id {id_type}, {_PIECES}")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    ``ids`` (with ``keep_ids``) holds a piece's little-endian unsigned 32-bit ids;
    :func:`sequences` joins those of a sequence.
    """
    ship(docs.sparkSession)
    pieces = materialize(cut(docs, vocabulary, capacity, text, doc_id, keep_ids), "pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = Placement(plan_bins(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = place(length, rank)
            columns = {c: batch.column(c) for c in out_columns[:5]} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            if keep_ids:
                columns["ids"] = batch.column("ids")
            yield pa.RecordBatch.from_pydict(columns)

    out_columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    # Starts are as many as tasks times lengths: not bounded, so never broadcast.
    ranked = pieces.join(starts.hint("merge"), ["length", "task"])
    return ranked.mapInArrow(put, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary), from pieces packed with ``keep_ids``; a sequence holds at most `capacity` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
